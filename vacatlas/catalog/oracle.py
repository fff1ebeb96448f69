"""The named queries in DuckDB's SQL, written apart from the Spark code.

Only the dictionaries and the derivation of the postings are shared. Queries
without an entry cannot be said in SQL: ``responsibilities`` needs look-ahead, and
fitted clusters have arbitrary ids; tests check these.
"""

from __future__ import annotations

from ..dictionaries import (
    CATEGORIES, CITY_COORDINATES, CITY_STATES, EMERGING_SKILLS, IMPORTANT_WORDS, REGIONS, SEARCH_COUNTRIES,
    SEARCH_LOCATIONS, SEARCH_TITLES, SKILLS, TITLE_STOP_WORDS,
)
from ..functions.patterns import SPACE_CHARS
from ..operators.advice import GENERAL, ORDER, SENTENCES
from ..plans.report import TABLES
from .tables import POSTINGS_SQL, STOP_WORDS

SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"\p{L}\p{N}_"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _strip(column: str) -> str:
    chars = " || ".join(f"chr({ord(c)})" for c in SPACE_CHARS)
    return f"trim({column}, {chars})"


def _case(pairs, default: str) -> str:
    whens = " ".join(f"WHEN contains(lower(location), {_q(key.lower())}) THEN {value}" for key, value in pairs)
    return f"CASE {whens} ELSE {default} END"


def _pay(column: str) -> str:
    number = f"try_cast({column} AS DOUBLE)"
    bare = rf"try_cast(regexp_extract(replace(replace({column}, ',', ''), '$', ''), '([0-9]+\.?[0-9]*)', 1) AS DOUBLE)"
    amount = f"coalesce({number}, {bare})"
    return f"CASE WHEN {amount} < 1000 THEN {amount} * 2080 WHEN {amount} < 10000 THEN {amount} * 12 ELSE {amount} END"


_EXP = rf"years?{SPACE}*(?:of{SPACE}+)?(?:experience|exp"
_YEARS = [
    rf"(?i)(\p{{Nd}}+){SPACE}*[-–to]+{SPACE}*(\p{{Nd}}+)\+?{SPACE}*{_EXP})",
    rf"(?i)(\p{{Nd}}+)\+?{SPACE}*{_EXP})",
    rf"(?i)(?:minimum|min|at{SPACE}+least){SPACE}+(\p{{Nd}}+){SPACE}*years?",
    rf"(?i)(\p{{Nd}}+){SPACE}*{_EXP}|relevant)",
]


def _years(group: int) -> str:
    patterns = _YEARS if group == 1 else _YEARS[:1]
    whens = " ".join(
        f"WHEN regexp_matches(description, {_q(p)}) THEN try_cast(regexp_extract(description, {_q(p)}, {group}) AS INT)"
        for p in patterns
    )
    return f"CASE {whens} END"


def _cleaned(source: str) -> str:
    untagged = "regexp_replace(coalesce(description, ''), '<[^>]+>', ' ', 'g')"
    return f"""SELECT * REPLACE (
      {_strip("coalesce(title, '')")} AS title,
      {_strip("coalesce(company, 'Unknown')")} AS company,
      {_strip("coalesce(location, '')")} AS location,
      trim(regexp_replace({untagged}, {_q(SPACE + '+')}, ' ', 'g')) AS description) FROM {source}"""


_REGION = _case([(city, _q(region)) for region, cities in REGIONS.items() for city in cities], "'Other'")
_STATE = _case([(city, _q(state)) for city, state in CITY_STATES.items()], "NULL")
_CODE = rf"nullif(regexp_extract(location, ',{SPACE}*([A-Z]{{2}})(?:$|[^{WORD}])', 1), '')"
_LAT = _case([(city, f"{lat}::DOUBLE") for city, (lat, _) in CITY_COORDINATES.items()], "NULL")
_LON = _case([(city, f"{lon}::DOUBLE") for city, (_, lon) in CITY_COORDINATES.items()], "NULL")


def _enriched(source: str) -> str:
    return f"""SELECT *, {_LAT} AS latitude, {_LON} AS longitude, {_REGION} AS region, {_STATE} AS state,
      {_years(1)} AS yoe_min, {_years(2)} AS yoe_max,
      {_pay('salary_min')} AS salary_min_annual, {_pay('salary_max')} AS salary_max_annual FROM {source}"""


def _occurrences(words) -> str:
    return " + ".join(
        f"(length(l) - length(replace(l, {_q(w)}, ''))) // {len(w)}" for w in words
    )


def _has(word: str) -> str:
    if len(word) > 3:
        return f"contains(l, {_q(word)})"
    body = word.replace("+", r"\+")
    after = f"(?:$|[^{WORD}])" if word[-1].isalnum() else f"[{WORD}]"
    return f"regexp_matches(l, {_q(f'(?:^|[^{WORD}]){body}{after}')})"


_SKILL_ROWS = ", ".join(
    f"CASE WHEN {_has(word)} THEN {{'category': {_q(category)}, 'skill': {_q(word)}}} END"
    for category, words in SKILLS.items() for word in words
)

_STEPS = {
    "raw": POSTINGS_SQL,
    "first_by_key": """SELECT * FROM raw
      QUALIFY row_number() OVER (PARTITION BY title, company, location ORDER BY posting_id) = 1""",
    "deduped": "SELECT * FROM first_by_key QUALIFY row_number() OVER (PARTITION BY url ORDER BY posting_id) = 1",
    "raw_cleaned": _cleaned("raw"),
    "cleaned": _cleaned("deduped"),
    "processed": _enriched("cleaned"),
    "raw_enriched": _enriched("raw_cleaned"),
    "lowered": "SELECT posting_id, (posting_id % 9)::INT AS cluster_id, lower(description) AS l FROM cleaned",
    "scores": "SELECT cluster_id, " + ", ".join(
        f"sum({_occurrences(words)}) AS c{i}" for i, words in enumerate(CATEGORIES.values())
    ) + " FROM lowered GROUP BY cluster_id",
    "long_scores": " UNION ALL ".join(
        f"SELECT cluster_id, {i} AS ordinal, {_q(name)} AS category, c{i} AS score FROM scores"
        for i, name in enumerate(CATEGORIES)
    ),
    "best": """SELECT cluster_id, CASE WHEN score > 0 THEN category ELSE 'Cluster ' || cluster_id END AS label
      FROM long_scores QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, ordinal) = 1""",
    "labels": """SELECT cluster_id, CASE WHEN nth = 1 THEN label ELSE label || ' (' || nth || ')' END AS cluster_label
      FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cluster_id) AS nth FROM best)""",
    "labelled": "SELECT p.*, cluster_label FROM processed p JOIN labels ON cluster_id = posting_id % 9",
    "skills": f"""SELECT posting_id, s.category AS category, s.skill AS skill
      FROM (SELECT posting_id, unnest([{_SKILL_ROWS}]) AS s FROM lowered) WHERE s IS NOT NULL""",
    "frequency": "SELECT category, skill, count(*) AS n FROM skills GROUP BY ALL",
    "totals": "SELECT skill, sum(n)::BIGINT AS n FROM frequency GROUP BY skill",
}
_NEEDS = {
    "first_by_key": ["raw"], "deduped": ["first_by_key"], "raw_cleaned": ["raw"], "cleaned": ["deduped"],
    "processed": ["cleaned"], "raw_enriched": ["raw_cleaned"], "lowered": ["cleaned"], "scores": ["lowered"],
    "long_scores": ["scores"], "best": ["long_scores"], "labels": ["best"], "labelled": ["processed", "labels"],
    "skills": ["lowered"], "frequency": ["skills"], "totals": ["frequency"],
}


class _Query(str):
    """SQL that remembers its steps, so that several queries can share them."""

    steps: list[str]
    own: str


def _with(step: str, select: str, **extra: str) -> _Query:
    """``select`` with the steps up to ``step`` before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    add(step)
    views = [f"{name} AS ({body})" for name, body in extra.items()]
    query = _Query(f"WITH {', '.join([*map(_step, order), *views])} {select}")
    query.steps, query.own = order, f"WITH {', '.join(views)} {select}" if views else select
    return query


def _step(name: str) -> str:
    return f"{name} AS MATERIALIZED ({_STEPS[name]})"


def _together(queries: dict[str, _Query], each: str) -> str:
    """``each`` over several queries in a row, their steps taken once."""
    order = list(dict.fromkeys(step for query in queries.values() for step in query.steps))
    rows = " UNION ALL ".join(each.format(name=name, query=query.own) for name, query in queries.items())
    return f"WITH {', '.join(map(_step, order))} {rows}"


def _say(label: str, source: str, **values: str) -> str:
    body = _q(SENTENCES[label])
    for name, value in values.items():
        body = f"replace({body}, '{{{name}}}', ({value})::VARCHAR)"
    return f"SELECT {ORDER.index(label)}::INT AS position, {_q(label)} AS label, {body} AS body FROM {source}"


def _suggestions() -> _Query:
    usd = "'$' || format('{{:,.0f}}', {})".format
    ranked = "(SELECT string_agg(skill, ', ' ORDER BY n DESC, skill) AS names FROM (SELECT skill, n FROM totals {} ORDER BY n DESC, skill LIMIT 5)) WHERE names IS NOT NULL"
    paid = """(SELECT {0} AS name, quantile_cont(salary_max_annual, 0.5) AS m FROM labelled
        WHERE salary_max_annual IS NOT NULL AND {1} GROUP BY ALL ORDER BY m DESC, name LIMIT 1)"""
    parts = [
        _say("TRENDING SKILLS", ranked.format(f"WHERE skill IN {_in(EMERGING_SKILLS)}"), skills="names"),
        _say("MUST-HAVE SKILLS", ranked.format(""), skills="names"),
        _say("CLOUD PLATFORM", "(SELECT skill FROM frequency WHERE category = 'cloud' ORDER BY n DESC, skill LIMIT 1)", skill="upper(skill)"),
        _say("HOT CATEGORY", "c WHERE position = 1", category="cluster_label", pct="format('{:.1f}', pct)", n="n"),
        _say(
            "NICHE OPPORTUNITIES", """(SELECT string_agg(cluster_label, ', ' ORDER BY position) AS names FROM c
            WHERE categories > 3 AND position > categories - 3) WHERE names IS NOT NULL""", categories="names",
        ),
        _say(
            "SALARY BENCHMARKS", """(SELECT quantile_cont(salary_max_annual, 0.5) AS a, quantile_cont(salary_max_annual, 0.75) AS b,
            quantile_cont(salary_max_annual, 0.9) AS c FROM labelled) WHERE a IS NOT NULL""", median=usd("a"), p75=usd("b"), p90=usd("c"),
        ),
        _say("HIGHEST PAYING", paid.format("cluster_label", "cluster_label IS NOT NULL"), category="name", median=usd("m")),
        _say("TOP PAYING REGION", paid.format("region", "region <> 'Other'"), region="name", median=usd("m")),
        _say("TOP HUB", "(SELECT region, count(*) AS n FROM labelled WHERE region <> 'Other' GROUP BY region ORDER BY n DESC, region LIMIT 1)", region="region", n="n"),
        _say("INTERNATIONAL", "(SELECT count(*) AS n FROM labelled WHERE region IN ('Singapore', 'Hong Kong')) WHERE n > 0", n="n"),
        _say(
            "EXPERIENCE", "bands WHERE median IS NOT NULL", median="format('{:.0f}', median)", entry="entry", mid="mid", senior="senior",
        ),
        _say("ENTRY-LEVEL", "bands WHERE entry > 0", pct="format('{:.0f}', 100.0 * entry / (entry + mid + senior))"),
        *(f"SELECT {ORDER.index(label)}::INT, {_q(label)}, {_q(SENTENCES[label])}" for label in GENERAL),
    ]
    query = _with(
        "labelled", " UNION ALL ".join(parts),
        c="""SELECT cluster_label, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM labelled) AS pct,
          row_number() OVER (ORDER BY count(*) DESC, cluster_label) AS position, count(*) OVER () AS categories
          FROM labelled GROUP BY cluster_label""",
        bands="""SELECT count(*) FILTER (yoe_min <= 2) AS entry, count(*) FILTER (yoe_min > 2 AND yoe_min <= 5) AS mid,
          count(*) FILTER (yoe_min > 5) AS senior, quantile_cont(yoe_min::DOUBLE, 0.5) AS median FROM labelled""",
    )
    skills = _with("totals", "")
    steps = list(dict.fromkeys([*query.steps, *skills.steps]))
    whole = _Query(f"WITH {', '.join(map(_step, steps))} SELECT * FROM ({query.own})")
    whole.steps, whole.own = steps, query.own
    return whole


#: Tables of the written report whose query has another name.
_REPORT = {
    "region_categories": "crosstab_long", "salary_by_region": "box_stats_region", "salary_by_category": "box_stats_cluster",
    "yoe_by_category": "box_yoe_cluster", "skills_by_category": "top_skills_by_category",
}


def _r(expression: str, name: str) -> str:
    return f"round(({expression})::DOUBLE, 6) AS {name}"


def _median(column: str) -> str:
    return f"quantile_cont({column}::DOUBLE, 0.5)"


def _box(step: str, key: str, value: str, where: str = "TRUE") -> _Query:
    return _with(
        step,
        f"""SELECT key, {_r('q1', 'q1')}, {_r('median', 'median')}, {_r('q3', 'q3')}, count(*) AS rows,
          min(x) AS low, max(x) AS high,
          min(x) FILTER (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
          max(x) FILTER (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
          count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
          FROM v JOIN b USING (key) WHERE (SELECT count(*) FROM v) >= 5 GROUP BY key, q1, median, q3 HAVING count(*) >= 3""",
        v=f"SELECT {key} AS key, {value}::DOUBLE AS x FROM {step} WHERE {key} IS NOT NULL AND {value} IS NOT NULL AND {where}",
        b="SELECT key, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY key",
    )


def _histogram(value: str, bins: int) -> str:
    return _with("processed", f"""SELECT bin, {_r(f'lo + bin * ((hi - lo) / {bins})', 'low')},
          {_r(f'lo + (bin + 1) * ((hi - lo) / {bins})', 'high')}, count(x) AS n
        FROM (SELECT unnest(range(0, {bins})) AS bin, lo, hi FROM s)
        LEFT JOIN (SELECT x, least(floor((x - lo) / ((hi - lo) / {bins})), {bins} - 1) AS b FROM v, s) ON b = bin
        GROUP BY bin, lo, hi""",
        v=f"SELECT {value}::DOUBLE AS x FROM processed WHERE {value} IS NOT NULL",
        s="SELECT min(x) AS lo, max(x) AS hi FROM v")


def _readable(value: str, bins: int) -> str:
    return _with("processed", f"""SELECT bin, {_r('(first + bin) * step', 'low')}, {_r('(first + bin + 1) * step', 'high')}, count(x) AS n
        FROM (SELECT unnest(range(0, (last - first + 1)::BIGINT)) AS bin, step, first FROM s)
        LEFT JOIN (SELECT x, floor(x / step) - first AS b FROM v, s) ON b = bin GROUP BY bin, first, step""",
        v=f"SELECT {value}::DOUBLE AS x FROM processed WHERE {value} IS NOT NULL",
        e="SELECT min(x) AS lo, max(x) AS hi FROM v",
        t=f"""SELECT lo, hi, unnest([1.0::DOUBLE, 2, 5, 10, 20]) * pow(10.0::DOUBLE, floor(log10((hi - lo) / {bins}))) AS step FROM e
          WHERE hi > lo UNION ALL SELECT lo, hi, 1 FROM e WHERE hi = lo""",
        s=f"""SELECT min(step) AS step, floor(any_value(lo) / min(step)) AS first, floor(any_value(hi) / min(step)) AS last FROM t
          WHERE floor(hi / step) - floor(lo / step) < {bins}""")


def _terms(stop_words) -> str:
    return rf"""WITH words AS (
        SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[{WORD}]{{2,}}'), lambda w: w NOT IN {_in(stop_words)}) AS w
        FROM documents),
      terms AS (
        SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
        FROM words)"""


def _tfidf(stop_words) -> str:
    return _terms(stop_words) + """,
      tf AS (SELECT doc_id, term, count(*) AS n FROM terms GROUP BY ALL),
      vocabulary AS (
        SELECT term, count(*) AS rows FROM tf GROUP BY term),
      raw AS (
        SELECT doc_id, term, n, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + rows)) + 1 AS idf
        FROM tf JOIN vocabulary USING (term)),
      unit AS (SELECT *, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY doc_id)) AS weight FROM raw)
      SELECT term, sum(n)::BIGINT AS n, round(max(idf), 6) AS idf, round(sum(weight), 6) AS weight FROM unit GROUP BY term"""


def _lloyd(numbers: str, steps: int, select: str, **extra: str) -> str:
    """``select`` over the assignments (kk, vec_id, k, d) after some steps, from the first kk vectors, for each kk."""
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)",
        f"numbers AS ({numbers})",
        """c0 AS MATERIALIZED (SELECT kk, k, e AS c FROM numbers
          JOIN (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, e FROM v) ON k < kk)""",
    ]
    for step in range(steps + 1):
        parts.append(f"""a{step} AS MATERIALIZED (SELECT kk, vec_id, arg_min(k, list_distance(e, c)) AS k, min(list_distance(e, c)) AS d
          FROM v JOIN c{step} ON TRUE GROUP BY kk, vec_id)""")
        if step < steps:
            parts.append(f"""c{step + 1} AS MATERIALIZED (SELECT kk, k, coalesce(m, c) AS c FROM c{step} LEFT JOIN (
              SELECT kk, k, list(x ORDER BY i) AS m FROM (SELECT kk, k, i, avg(x) AS x FROM (
                SELECT kk, k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{step} JOIN v USING (vec_id)) GROUP BY ALL)
              GROUP BY kk, k) USING (kk, k))""")
    parts += [f"{name} AS MATERIALIZED ({body})" for name, body in extra.items()]
    return f"WITH {', '.join(parts)} {select}"


_WEEK = "DATE '1970-01-04' + (floor(date_diff('day', DATE '1970-01-04', {d}) / 7) * 7)::INT"
_SENTENCE_BREAK = "chr(57344)"
_IMPORTANT = [w for words in SKILLS.values() for w in words] + IMPORTANT_WORDS


def oracles() -> dict[str, str]:
    grid_country = "CASE " + " ".join(
        f"WHEN contains(lower(location), {_q(k)}) THEN {_q(v)}" for k, v in SEARCH_COUNTRIES.items()
    )
    is_abroad = " OR ".join(f"contains(lower(g.location), {_q(k)})" for k in SEARCH_COUNTRIES)
    wide = ", ".join(
        f"coalesce(sum(n) FILTER (cluster_label = {_q(name)}), 0)::BIGINT AS \"{name}\""
        for name in ("LLM/GenAI", "Computer Vision", "Fraud Detection/Risk")
    )
    found = {
        "union_batches": _with("raw", """
            SELECT posting_id, site, 'Data Scientist' AS search_query, 'New York, NY' AS search_location,
              NULL::VARCHAR AS salary_min, salary_max FROM raw WHERE site = 'linkedin'
            UNION ALL SELECT posting_id, site, 'ML Engineer', 'Singapore', salary_min, NULL FROM raw WHERE site = 'indeed'"""),
        "search_grid": _with("raw", f"""
            SELECT g.title, g.location, NOT ({is_abroad}) AS is_us,
              {grid_country.replace('location', 'g.location')} ELSE 'USA' END AS country,
              count(f.posting_id) AS found
            FROM g LEFT JOIN (SELECT posting_id, {_strip("coalesce(title, '')")} AS title,
              {_strip("coalesce(location, '')")} AS location FROM raw) f ON f.title = g.title AND f.location = g.location
            GROUP BY ALL""",
            g=f"""SELECT unnest([{', '.join(_q(t) for t in SEARCH_TITLES)}]) AS title, location
              FROM (SELECT unnest([{', '.join(_q(t) for t in SEARCH_LOCATIONS)}]) AS location)"""),
        "standardize": _with("raw", """SELECT posting_id, title, company, location, md5(description) AS description,
            salary_min, salary_max, url, date_posted, site, search_query, NULL::VARCHAR AS search_location FROM raw"""),
        "recent": _with("raw", "SELECT posting_id, date_posted FROM raw WHERE date_posted >= DATE '2001-07-25'"),
        "snapshot_roundtrip": _with("raw", f"""SELECT posting_id, {_pay('salary_min')} AS salary_min_annual,
            {_pay('salary_max')} AS salary_max_annual FROM raw"""),
        "typed_load": _with("raw", """SELECT posting_id, try_cast(salary_min AS DOUBLE) AS salary_min,
            try_cast(salary_max AS DOUBLE) AS salary_max,
            CASE WHEN posting_id % 13 <> 0 AND posting_id % 3 = 0 THEN 'python,sql' ELSE '' END AS languages,
            (CASE WHEN posting_id % 13 <> 0 AND posting_id % 3 = 0 THEN 2 ELSE 0 END)::BIGINT AS categories FROM raw"""),
        "dedup_postings": _with("deduped", "SELECT posting_id, title, company, location, url FROM deduped"),
        "clean_postings": _with("raw_cleaned", """SELECT posting_id, title, company, location,
            md5(description) AS description FROM raw_cleaned"""),
        "clean_pages": f"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
            {_q(SPACE + '+')}, ' ', 'g'))) AS description FROM pages""",
        "geocode": _with("raw_cleaned", f"SELECT posting_id, location, {_LAT} AS latitude, {_LON} AS longitude FROM raw_cleaned"),
        "geocode_table": _with("raw_cleaned", f"SELECT posting_id, location, {_LAT} AS latitude, {_LON} AS longitude FROM raw_cleaned"),
        "regions": _with("raw_cleaned", f"SELECT posting_id, location, {_REGION} AS region FROM raw_cleaned"),
        "states": _with("raw_cleaned", f"""SELECT posting_id, location, {_STATE} AS state_folded,
            coalesce({_STATE}, {_CODE}) AS state FROM raw_cleaned"""),
        "yoe": _with("raw_cleaned", f"SELECT posting_id, {_years(1)} AS yoe_min, {_years(2)} AS yoe_max FROM raw_cleaned"),
        "salary_annual": _with("raw", f"""SELECT posting_id, salary_min, salary_max, {_pay('salary_min')} AS salary_min_annual,
            {_pay('salary_max')} AS salary_max_annual FROM raw"""),
        "skills_long": _with("skills", "SELECT posting_id, category, skill FROM skills"),
        "summaries": _with("cleaned", """SELECT posting_id, md5(CASE WHEN length(description) < 50 THEN description
              ELSE coalesce(summary, '') END) AS summary
            FROM cleaned LEFT JOIN picked USING (posting_id)""",
            split=f"""SELECT posting_id, list_filter(list_transform(string_split(
                regexp_replace(description, '([.!?]){SPACE}+', '\\1' || {_SENTENCE_BREAK}, 'g'), {_SENTENCE_BREAK}),
                lambda s: {_strip('s')}), lambda s: length(s) > 20) AS sentences FROM cleaned""",
            sentences="""SELECT posting_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) - 1 AS i,
                len(sentences) AS n FROM split""",
            scored=f"""SELECT *, len(list_filter(regexp_split_to_array(lower(s), {_q(SPACE + '+')}),
                lambda w: w IN {_in(_IMPORTANT)})) * (1.0::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - (i::DOUBLE / n) * 0.5::DOUBLE))
                AS score FROM sentences""",
            ranked="""SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY score DESC, i DESC) AS rank FROM scored""",
            picked="""SELECT posting_id, string_agg(s, ' ' ORDER BY i) AS summary FROM ranked WHERE n <= 3 OR rank <= 3
                GROUP BY posting_id"""),
        "title_words": _with("cleaned", """SELECT cluster_id, string_agg(upper(word[1]) || word[2:], ' ' ORDER BY rank) AS words
            FROM ranked WHERE rank <= 3 GROUP BY cluster_id""",
            words=f"""SELECT (posting_id % 9)::INT AS cluster_id, unnest(regexp_split_to_array(lower(title), {_q(SPACE + '+')})) AS word
                FROM cleaned""",
            counted=f"""SELECT cluster_id, word, count(*) AS n FROM words
                WHERE word NOT IN {_in(TITLE_STOP_WORDS)} AND length(word) > 2 GROUP BY ALL""",
            ranked="SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, word) AS rank FROM counted"),
        "filters_combined": _with("labelled", """SELECT posting_id, title, company, location, region, salary_max_annual,
              yoe_min, cluster_label FROM labelled
            WHERE (region IN ('SF Bay Area', 'Greater NYC', 'Other') OR region IS NULL)
              AND (cluster_label IN ('LLM/GenAI', 'Computer Vision', 'Fraud Detection/Risk') OR cluster_label IS NULL)
              AND (salary_max_annual BETWEEN 90000 AND 200000 OR salary_max_annual IS NULL)
              AND (yoe_min BETWEEN 0 AND 5 OR yoe_min IS NULL)"""),
        "filter_domain": _with("labelled", """SELECT string_agg(DISTINCT region, '|' ORDER BY region) AS regions,
            string_agg(DISTINCT cluster_label, '|' ORDER BY cluster_label) AS categories,
            min(salary_max_annual) AS salary_low, max(salary_max_annual) AS salary_high,
            min(salary_max_annual) < max(salary_max_annual) AS salary_usable, 0 AS yoe_low, 20 AS yoe_high FROM labelled"""),
        "search_text": _with("processed", """SELECT posting_id, title, company, location FROM processed
            WHERE regexp_matches(lower(title), 'engineer|hong.kong') OR regexp_matches(lower(company), 'engineer|hong.kong')
              OR regexp_matches(lower(location), 'engineer|hong.kong')"""),
        "min_support": _with("processed", """SELECT posting_id, company, salary_max_annual FROM processed
            WHERE salary_max_annual IS NOT NULL AND company IN (SELECT company FROM processed
              WHERE salary_max_annual IS NOT NULL GROUP BY company HAVING count(*) >= 10)
              AND (SELECT count(*) FROM processed WHERE salary_max_annual IS NOT NULL) >= 5"""),
        "international": _with("labelled", """SELECT latitude, longitude, title, company, location, cluster_label FROM labelled
            WHERE region IN ('Singapore', 'Hong Kong') AND latitude IS NOT NULL AND longitude IS NOT NULL"""),
        "kpis": _with("labelled", f"""SELECT count(*) AS postings, count(DISTINCT company) AS companies,
            count(DISTINCT region) AS regions, count(DISTINCT cluster_label) AS categories,
            {_median('salary_max_annual')} AS median_salary, {_median('yoe_min')} AS median_yoe FROM labelled"""),
        "category_counts": _with("labelled", """SELECT cluster_label, count(*) AS n FROM labelled WHERE cluster_label IS NOT NULL
            GROUP BY cluster_label ORDER BY n DESC, cluster_label LIMIT 12"""),
        "category_share": _with("labelled", f"""SELECT cluster_label, count(*) AS n,
            {_r('count(*)::DOUBLE / (SELECT count(cluster_label) FROM labelled)', 'share')}
            FROM labelled WHERE cluster_label IS NOT NULL GROUP BY cluster_label"""),
        "top_companies": _with("processed", """SELECT company, count(*) AS n FROM processed GROUP BY company
            ORDER BY n DESC, company LIMIT 15"""),
        "state_counts": _with("processed", "SELECT state, count(*) AS n FROM processed WHERE state IS NOT NULL GROUP BY state"),
        "region_counts": _with("processed", "SELECT region, count(*) AS n FROM processed WHERE region <> 'Other' GROUP BY region"),
        "region_stats": _with("processed", f"""SELECT region, count(*) AS jobs, count(DISTINCT company) AS companies,
            {_r(_median('salary_max_annual'), 'median_salary')}, {_r(_median('yoe_min'), 'median_yoe')}
            FROM processed GROUP BY region"""),
        "region_stats_sketched": _with("processed", """SELECT region, count(*) AS jobs, count(DISTINCT company) AS companies,
            quantile_disc(salary_max_annual, 0.5) AS median_salary, quantile_disc(yoe_min::DOUBLE, 0.5) AS median_yoe
            FROM processed GROUP BY region"""),
        "region_report": _with("processed", f"""SELECT region, count(*) AS jobs, {_r('avg(salary_max_annual)', 'avg_salary')},
            {_r('avg(yoe_min)', 'avg_yoe')} FROM processed WHERE region <> 'Other' GROUP BY region
            ORDER BY jobs DESC, region LIMIT 10"""),
        "cluster_summary": _with("labelled", f"""SELECT cluster_label AS cluster, count(*) AS count,
              {_r('count(*) * 100.0 / (SELECT count(*) FROM labelled)', 'pct')},
              {_r('avg(salary_min_annual)', 'avg_salary_min')}, {_r('avg(salary_max_annual)', 'avg_salary_max')},
              {_r('avg(yoe_min)', 'avg_yoe')}, any_value(top_regions) AS top_regions
            FROM labelled LEFT JOIN largest USING (cluster_label) GROUP BY cluster_label""",
            largest="""SELECT cluster_label, string_agg(region || ' (' || n || ')', ', ' ORDER BY n DESC, region) AS top_regions
              FROM (SELECT cluster_label, region, count(*) AS n FROM labelled GROUP BY cluster_label, region
                QUALIFY row_number() OVER (PARTITION BY cluster_label ORDER BY n DESC, region) <= 3) GROUP BY cluster_label"""),
        "salary_stats": _with("processed", f"""SELECT {_r('quantile_cont(salary_max_annual, 0.25)', 'p25')},
            {_r('quantile_cont(salary_max_annual, 0.5)', 'median')}, {_r('quantile_cont(salary_max_annual, 0.75)', 'p75')},
            {_r('avg(salary_max_annual)', 'mean')} FROM processed"""),
        "salary_benchmarks": _with("processed", f"""SELECT {_r('quantile_cont(salary_max_annual, 0.5)', 'median')},
            {_r('quantile_cont(salary_max_annual, 0.75)', 'p75')}, {_r('quantile_cont(salary_max_annual, 0.9)', 'p90')}
            FROM processed"""),
        "median_salary_rank": _with("labelled", f"""SELECT cluster_label, {_r(_median('salary_max_annual'), 'median_salary')}
            FROM labelled WHERE salary_max_annual IS NOT NULL GROUP BY cluster_label"""),
        "median_salary_by_region": _with("processed", f"""SELECT region, {_r(_median('salary_max_annual'), 'median_salary')}
            FROM processed WHERE salary_max_annual IS NOT NULL AND region <> 'Other' GROUP BY region"""),
        "box_stats_region": _box("processed", "region", "salary_max_annual", "region <> 'Other'"),
        "box_stats_cluster": _box("labelled", "cluster_label", "salary_max_annual"),
        "box_yoe_cluster": _box("labelled", "cluster_label", "yoe_min"),
        "yoe_histogram": _with("processed", f"""SELECT bin, count(x) AS n, {_r('(SELECT quantile_cont(x::DOUBLE, 0.5) FROM v)', 'median')}
            FROM (SELECT unnest(range(0, 21)) AS bin) LEFT JOIN v ON floor(x) = bin GROUP BY bin""",
            v="SELECT least(greatest(yoe_min, 0), 20) AS x FROM processed WHERE yoe_min IS NOT NULL"),
        "salary_histogram": _histogram("salary_max_annual", 30),
        "years_histogram": _histogram("yoe_min", 20),
        "salary_histogram_readable": _readable("salary_max_annual", 30),
        "years_histogram_readable": _readable("yoe_min", 20),
        "box_stats_region_all": _box("processed", "region", "salary_max_annual"),
        "exclude_other": _with("processed", "SELECT posting_id, region FROM processed WHERE region IS DISTINCT FROM 'Other'"),
        "yoe_kpis": _with("processed", f"""SELECT {_r(_median('yoe_min'), 'median')},
            (SELECT yoe_min::DOUBLE FROM processed WHERE yoe_min IS NOT NULL GROUP BY yoe_min
              ORDER BY count(*) DESC, yoe_min LIMIT 1) AS mode,
            {_r('100.0 * count(*) FILTER (yoe_min <= 2) / count(yoe_min)', 'entry_pct')} FROM processed"""),
        "yoe_bands": _with("processed", f"""SELECT count(*) FILTER (yoe_min <= 2) AS entry,
            count(*) FILTER (yoe_min > 2 AND yoe_min <= 5) AS mid, count(*) FILTER (yoe_min > 5) AS senior,
            {_r('100.0 * count(*) FILTER (yoe_min <= 2) / count(yoe_min)', 'entry_pct')},
            {_r(_median('yoe_min'), 'median')} FROM processed"""),
        "crosstab_wide": _with("labelled", f"""SELECT region, {wide} FROM (SELECT region, cluster_label, count(*) AS n
            FROM labelled WHERE region <> 'Other' GROUP BY ALL) GROUP BY region"""),
        "crosstab_long": _with("labelled", """SELECT region, cluster_label, count(posting_id) AS n
            FROM (SELECT DISTINCT region FROM labelled) JOIN (SELECT DISTINCT cluster_label FROM labelled) ON TRUE
            LEFT JOIN labelled USING (region, cluster_label) GROUP BY ALL"""),
        "skill_frequency": _with("frequency", "SELECT category, skill, n FROM frequency"),
        "top_skills": _with("totals", "SELECT skill, n FROM totals ORDER BY n DESC, skill LIMIT 20"),
        "top_skills_by_category": _with("frequency", """SELECT category, skill, n,
            row_number() OVER (PARTITION BY category ORDER BY n DESC, skill) AS rank FROM frequency
            QUALIFY rank <= 10"""),
        "skill_gaps": _with("totals", f"""SELECT * FROM (
            (SELECT 'emerging' AS kind, row_number() OVER (ORDER BY n DESC, skill) AS rank, skill, n FROM totals
              WHERE skill IN {_in(EMERGING_SKILLS)} ORDER BY rank LIMIT 5)
            UNION ALL (SELECT 'required', row_number() OVER (ORDER BY n DESC, skill) AS rank, skill, n FROM totals
              ORDER BY rank LIMIT 5)
            UNION ALL (SELECT 'cloud', row_number() OVER (ORDER BY n DESC, skill) AS rank, skill, n FROM frequency
              WHERE category = 'cloud' ORDER BY rank LIMIT 1))"""),
        "category_trends": _with("labelled", f"""
            SELECT 'hot' AS kind, position, cluster_label, n, {_r('pct', 'pct')} FROM c WHERE position = 1
            UNION ALL SELECT 'niche', position, cluster_label, n, {_r('pct', 'pct')} FROM c
              WHERE categories > 3 AND position > categories - 3""",
            c="""SELECT cluster_label, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM labelled) AS pct,
              row_number() OVER (ORDER BY count(*) DESC, cluster_label) AS position, count(*) OVER () AS categories
              FROM labelled GROUP BY cluster_label"""),
        "geo_trends": _with("processed", """SELECT
            (SELECT region FROM processed WHERE region <> 'Other' GROUP BY region ORDER BY count(*) DESC, region LIMIT 1) AS top_region,
            (SELECT count(*) FROM processed WHERE region <> 'Other' GROUP BY region ORDER BY count(*) DESC LIMIT 1) AS top_count,
            (SELECT count(*) FROM processed WHERE region IN ('Singapore', 'Hong Kong')) AS international"""),
        "city_density": _with("processed", """SELECT latitude, longitude, count(*) AS n FROM processed
            WHERE latitude IS NOT NULL GROUP BY ALL"""),
        "map_centre": _with("processed", f"""SELECT {_r('avg(latitude)', 'latitude')}, {_r('avg(longitude)', 'longitude')}
            FROM processed WHERE latitude IS NOT NULL"""),
        "cluster_density": _with("labelled", """SELECT cluster_label,
              lower(replace(replace(cluster_label, '/', '_'), ' ', '_')) AS name, latitude, longitude, count(*) AS n
            FROM labelled WHERE latitude IS NOT NULL AND cluster_label IN (SELECT cluster_label FROM labelled
              WHERE latitude IS NOT NULL GROUP BY cluster_label HAVING count(*) >= 2) GROUP BY ALL"""),
        "tfidf_weights": _tfidf(STOP_WORDS),
        "silhouette": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
              FROM embeddings),
            m AS (SELECT label, i, avg(x) AS mean, avg(x * x) AS square, count(*) AS n FROM e GROUP BY ALL),
            d AS (SELECT vec_id, e.label AS own, m.label AS other, any_value(n) AS n,
                sum(x * x + square - 2 * x * mean) * any_value(n) AS total
              FROM e JOIN m USING (i) GROUP BY ALL),
            ab AS (SELECT vec_id, own AS label, max(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a,
              min(CASE WHEN own <> other THEN total / n END) AS b FROM d GROUP BY ALL)
            SELECT vec_id, label, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 6) AS width FROM ab""",
        "kmeans_embeddings": _lloyd("SELECT 10 AS kk", 3, """
            SELECT a3.k::INT AS cluster_id, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last,
              round((SELECT sum(d * d) FROM a3), 6) AS cost FROM a3 GROUP BY a3.k"""),
        "choose_k": _lloyd("""SELECT unnest(range(least(5, n - 1), 1 + least(15, n - 1))) AS kk
            FROM (SELECT count(*) AS n FROM embeddings)""", 2, """
            SELECT kk::INT AS k, round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS score,
              rank() OVER (ORDER BY round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 12) DESC, kk) = 1 AS chosen
            FROM (SELECT kk, x, own, sum(total) FILTER (own = k) / nullif(sum(n) FILTER (own = k) - 1, 0) AS a,
                min(total / n) FILTER (own <> k) AS b
              FROM (SELECT p.kk, apart.x, p.k AS own, q.k AS k, sum(apart.d) AS total, count(*) AS n
                FROM apart JOIN a2 p ON p.vec_id = apart.x JOIN a2 q ON q.vec_id = apart.y AND q.kk = p.kk GROUP BY ALL)
              GROUP BY ALL) GROUP BY kk""",
            apart="SELECT p.vec_id AS x, q.vec_id AS y, list_distance(p.e, q.e) AS d FROM v p JOIN v q ON TRUE"),
        "silhouette_euclidean": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
              WHERE label IS NOT NULL AND embedding IS NOT NULL),
            d AS (SELECT p.vec_id, p.label, q.label AS other, sum(list_distance(p.e, q.e)) AS total, count(*) AS n
              FROM v p JOIN v q ON TRUE GROUP BY ALL),
            ab AS (SELECT vec_id, label, max(total / nullif(n - 1, 0)) FILTER (label = other) AS a,
                min(total / n) FILTER (label <> other) AS b FROM d GROUP BY ALL)
            SELECT vec_id, label, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 6) AS width FROM ab""",
        "vocabulary": _terms(STOP_WORDS) + " SELECT term, count(*) AS n FROM terms GROUP BY term ORDER BY n DESC, term LIMIT 5000",
        "keyword_dictionary": """WITH l AS (SELECT lower(text) AS l FROM documents WHERE text IS NOT NULL),
            w AS (SELECT w FROM (SELECT unnest(regexp_extract_all(l, '[a-z]+')) AS w FROM l) WHERE length(w) > 3
              GROUP BY w ORDER BY count(*) DESC, w LIMIT 2000)
            SELECT w AS word, count(*) AS documents, sum((length(l) - length(replace(l, w, ''))) // length(w))::BIGINT AS n
            FROM w JOIN l ON contains(l, w) GROUP BY w""",
        "cluster_labels": _with("labels", """SELECT cluster_id, cluster_label, count(*) AS n
            FROM lowered JOIN labels USING (cluster_id) GROUP BY ALL"""),
        "stream_ingest": _with("raw_enriched", "SELECT posting_id, region, state, yoe_min, salary_max_annual FROM raw_enriched"),
        "stream_dedup": _with("raw", "SELECT url, 1::BIGINT AS n FROM raw GROUP BY url"),
        "stream_snapshot": _with("processed", "SELECT posting_id, region, salary_max_annual FROM processed"),
        "weekly_counts": _with("raw_enriched", f"""SELECT {_WEEK.format(d='date_posted')} AS week, region, count(*) AS n
            FROM raw_enriched GROUP BY ALL"""),
        "weekly_closed": _with("raw_enriched", """
            SELECT 'late' AS kind, week, region, count(*) AS n FROM judged WHERE late GROUP BY ALL
            UNION ALL SELECT 'closed', week, region, count(*) FROM judged
              WHERE NOT late AND week + 7 <= (SELECT max(date_posted) - 7 FROM judged) GROUP BY ALL""",
            arrived=f"""SELECT date_posted, region, {_WEEK.format(d='date_posted')} AS week,
              year(date_posted + CASE WHEN posting_id % 10 = 0 THEN 550 ELSE 0 END) AS run FROM raw_enriched""",
            bounds="""SELECT run, max(last) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 7 AS bound
              FROM (SELECT run, max(date_posted) AS last FROM arrived GROUP BY run)""",
            judged="SELECT arrived.*, coalesce(week + 7 <= bound, FALSE) AS late FROM arrived JOIN bounds USING (run)"),
        "weekly_events": f"SELECT {_WEEK.format(d='ts::DATE')} AS week, event_type, count(*) AS n FROM events GROUP BY ALL",
    }
    found["suggestions"] = _suggestions()
    tables = {name: found[_REPORT.get(name, name)] for name in TABLES}
    found["report_tables"] = _together(tables, "SELECT '{name}' AS \"table\", (SELECT count(*) FROM ({query})) AS rows")
    return found
