"""The dictionaries the market operators match against.

Order matters throughout: the first matching entry wins, and ties between
categories go to the earlier one. Every operator takes its dictionary as a
parameter, so these are defaults.
"""

# City -> (latitude, longitude).
CITY_COORDINATES = {
    "new york": (40.7128, -74.0060),
    "manhattan": (40.7831, -73.9712),
    "brooklyn": (40.6782, -73.9442),
    "san francisco": (37.7749, -122.4194),
    "san jose": (37.3382, -121.8863),
    "palo alto": (37.4419, -122.1430),
    "mountain view": (37.3861, -122.0839),
    "sunnyvale": (37.3688, -122.0363),
    "menlo park": (37.4530, -122.1817),
    "seattle": (47.6062, -122.3321),
    "bellevue": (47.6101, -122.2015),
    "redmond": (47.6740, -122.1215),
    "boston": (42.3601, -71.0589),
    "cambridge": (42.3736, -71.1097),
    "los angeles": (34.0522, -118.2437),
    "santa monica": (34.0195, -118.4912),
    "chicago": (41.8781, -87.6298),
    "austin": (30.2672, -97.7431),
    "washington": (38.9072, -77.0369),
    "denver": (39.7392, -104.9903),
    "singapore": (1.3521, 103.8198),
    "hong kong": (22.3193, 114.1694),
    "jersey city": (40.7178, -74.0431),
    "newark": (40.7357, -74.1724),
    "hoboken": (40.7440, -74.0324),
    "oakland": (37.8044, -122.2712),
    "redwood city": (37.4852, -122.2364),
    "kirkland": (47.6769, -122.2060),
    "somerville": (42.3876, -71.0995),
    "waltham": (42.3765, -71.2356),
    "pasadena": (34.1478, -118.1445),
    "burbank": (34.1808, -118.3090),
}

# City -> US state.
CITY_STATES = {
    "new york": "NY",
    "manhattan": "NY",
    "brooklyn": "NY",
    "jersey city": "NJ",
    "newark": "NJ",
    "hoboken": "NJ",
    "san francisco": "CA",
    "san jose": "CA",
    "palo alto": "CA",
    "mountain view": "CA",
    "sunnyvale": "CA",
    "menlo park": "CA",
    "oakland": "CA",
    "redwood city": "CA",
    "los angeles": "CA",
    "santa monica": "CA",
    "pasadena": "CA",
    "burbank": "CA",
    "seattle": "WA",
    "bellevue": "WA",
    "redmond": "WA",
    "kirkland": "WA",
    "boston": "MA",
    "cambridge": "MA",
    "somerville": "MA",
    "waltham": "MA",
    "chicago": "IL",
    "austin": "TX",
    "washington": "DC",
    "denver": "CO",
}

# Market region -> its cities.
REGIONS = {
    "Greater NYC": ["New York", "Manhattan", "Brooklyn", "Jersey City", "Newark", "Hoboken"],
    "SF Bay Area": [
        "San Francisco", "San Jose", "Palo Alto", "Mountain View",
        "Sunnyvale", "Oakland", "Menlo Park", "Redwood City",
    ],
    "Seattle Area": ["Seattle", "Bellevue", "Redmond", "Kirkland"],
    "Boston Area": ["Boston", "Cambridge", "Somerville", "Waltham"],
    "LA Area": ["Los Angeles", "Santa Monica", "Pasadena", "Burbank"],
    "Singapore": ["Singapore"],
    "Hong Kong": ["Hong Kong"],
}
OTHER_REGION = "Other"
INTERNATIONAL_REGIONS = ["Singapore", "Hong Kong"]

# Skill category -> keywords.
SKILLS = {
    "languages": [
        "python", "r", "sql", "java", "scala", "c++", "julia",
        "javascript", "typescript", "go", "rust", "matlab",
    ],
    "ml_frameworks": [
        "tensorflow", "pytorch", "keras", "scikit-learn", "sklearn",
        "xgboost", "lightgbm", "catboost", "hugging face", "huggingface",
        "transformers", "jax", "mlflow", "wandb",
    ],
    "data_tools": [
        "spark", "hadoop", "hive", "kafka", "airflow", "dbt",
        "snowflake", "redshift", "bigquery", "databricks", "dask",
        "ray", "presto", "athena",
    ],
    "cloud": [
        "aws", "gcp", "azure", "sagemaker", "vertex ai",
        "ec2", "s3", "lambda", "emr",
    ],
    "techniques": [
        "deep learning", "machine learning", "nlp",
        "natural language processing", "computer vision",
        "reinforcement learning", "recommendation systems",
        "time series", "forecasting", "a/b testing",
        "causal inference", "bayesian", "generative ai",
        "large language models", "llm", "rag",
        "retrieval augmented generation", "fine-tuning",
        "neural networks", "gradient boosting",
        "random forest", "regression", "classification",
        "clustering", "dimensionality reduction",
        "feature engineering", "mlops", "model deployment",
    ],
}

# Words that, next to the skills, mark a sentence as important.
IMPORTANT_WORDS = [
    "responsible", "develop", "build", "lead", "design",
    "implement", "analyze", "collaborate", "research",
    "experience", "required", "preferred", "team",
]

# Posting category -> keywords used to label a cluster.
CATEGORIES = {
    "LLM/GenAI": [
        "llm", "large language model", "generative ai", "gpt",
        "chatbot", "rag", "retrieval augmented", "fine-tuning",
        "prompt engineering", "langchain", "transformer",
    ],
    "NLP": [
        "nlp", "natural language", "text mining", "text classification",
        "sentiment analysis", "named entity", "information extraction",
        "speech recognition", "conversational ai",
    ],
    "Computer Vision": [
        "computer vision", "image recognition", "object detection",
        "image classification", "segmentation", "opencv", "cnn",
        "convolutional", "visual", "video analysis",
    ],
    "Analytics/A-B Testing": [
        "a/b test", "ab test", "experimentation", "causal inference",
        "statistical analysis", "product analytics", "business intelligence",
        "dashboarding", "metrics", "kpi",
    ],
    "Fraud Detection/Risk": [
        "fraud", "risk", "anomaly detection", "anti-money laundering",
        "compliance", "credit risk", "financial crime",
    ],
    "Recommendation Systems": [
        "recommendation", "recommender", "personalization",
        "collaborative filtering", "content-based filtering",
        "ranking", "search relevance",
    ],
    "MLOps/ML Engineering": [
        "mlops", "model deployment", "ml infrastructure",
        "ml pipeline", "feature store", "model monitoring",
        "ci/cd", "kubernetes", "docker", "microservice",
    ],
    "Robotics/Autonomous": [
        "robotics", "autonomous", "self-driving", "perception",
        "planning", "control systems", "sensor fusion", "lidar",
    ],
    "Time Series/Forecasting": [
        "time series", "forecasting", "demand prediction",
        "supply chain", "inventory", "pricing",
    ],
    "Healthcare/Bio": [
        "healthcare", "biotech", "clinical", "drug discovery",
        "genomics", "medical imaging", "health",
    ],
}

# Words of a job title that say nothing about the field.
TITLE_STOP_WORDS = [
    "the", "a", "an", "and", "or", "in", "at", "of", "for",
    "to", "with", "is", "-", "&", "/", "senior", "junior",
    "lead", "staff", "principal", "manager", "director",
    "i", "ii", "iii", "iv", "v",
]

# Skills counted as emerging.
EMERGING_SKILLS = [
    "llm", "large language models", "generative ai", "rag",
    "retrieval augmented generation", "fine-tuning", "langchain",
    "prompt engineering", "mlops", "feature store",
    "model monitoring", "vertex ai", "sagemaker",
    "dbt", "databricks", "ray", "jax",
    "rust", "go",
]

# The default search grid.
SEARCH_TITLES = [
    "Data Scientist", "Machine Learning Engineer", "Applied Scientist",
    "Research Scientist", "ML Engineer", "Data Science Manager",
]
SEARCH_LOCATIONS = [
    "New York, NY", "San Francisco, CA", "Seattle, WA", "Boston, MA",
    "Los Angeles, CA", "Chicago, IL", "Austin, TX", "Washington, DC",
    "San Jose, CA", "Denver, CO", "Singapore", "Hong Kong",
]

# Place outside the US -> country of the search.
SEARCH_COUNTRIES = {
    "singapore": "Singapore",
    "hong kong": "Hong Kong",
    "london": "UK",
    "tokyo": "Japan",
}
HOME_COUNTRY = "USA"
