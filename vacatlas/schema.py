"""Column contracts of the stages a posting goes through."""

from pyspark.sql import types as T

#: Raw postings, as collected. Salaries stay text until they are normalised.
RAW_POSTING = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("salary_min", T.StringType()),
        T.StructField("salary_max", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("date_posted", T.DateType()),
        T.StructField("site", T.StringType()),
        T.StructField("search_query", T.StringType()),
        T.StructField("search_location", T.StringType()),
    ]
)

#: Added by the processing stage.
PROCESSED_FIELDS = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("region", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("yoe_min", T.IntegerType()),
        T.StructField("yoe_max", T.IntegerType()),
        T.StructField("salary_min_annual", T.DoubleType()),
        T.StructField("salary_max_annual", T.DoubleType()),
    ]
)

KEY_SKILLS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

#: Columns that must be numeric in a processed table read back from text.
NUMERIC_COLUMNS = {
    "salary_min": "double",
    "salary_max": "double",
    "salary_min_annual": "double",
    "salary_max_annual": "double",
    "yoe_min": "double",
    "yoe_max": "double",
    "latitude": "double",
    "longitude": "double",
}
