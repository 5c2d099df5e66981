"""Word lists, lookup tables and patterns that results depend on.

Everything in this module is data, stated plainly.  Results only match across
implementations when these values are identical, so do not "improve" them here;
pass a changed :class:`hirescope.config.Config` instead.
"""

# --- Fixed values: skill taxonomy --------------------------------------------

TECHNICAL_SKILLS = (
    "python", "r", "sql", "javascript", "typescript", "java", "scala",
    "sas", "matlab", "go", "rust", "c++", "c#", "vba", "perl",
    "postgresql", "mysql", "sqlite", "mongodb", "redis", "elasticsearch",
    "oracle", "sql server", "mssql", "snowflake", "databricks",
    "bigquery", "redshift", "dynamo db", "dynamodb", "cassandra",
    "neo4j", "cockroachdb",
    "aws", "gcp", "google cloud", "azure", "cloud",
    "tableau", "power bi", "powerbi", "looker", "qlik",
    "superset", "metabase", "mode", "google data studio",
    "microstrategy", "sisense", "domo",
    "excel", "google sheets", "spreadsheets",
    "dbt", "airflow", "prefect", "dagster", "luigi",
    "spark", "hadoop", "kafka", "flink", "storm",
    "docker", "kubernetes", "k8s", "terraform",
    "git", "github", "gitlab", "bitbucket",
    "machine learning", "deep learning", "nlp",
    "tensorflow", "pytorch", "keras", "scikit-learn", "sklearn",
    "pandas", "numpy", "scipy", "matplotlib", "seaborn",
    "xgboost", "lightgbm", "catboost",
    "jupyter", "jupyter notebook", "google colab",
    "mlflow", "kubeflow", "weights & biases",
    "statistics", "regression", "hypothesis testing",
    "a/b testing", "experiment design", "bayesian",
    "etl", "data pipeline", "data warehouse",
    "talend", "informatica", "ssis", "fivetran", "stitch",
    "segment", "mixpanel", "amplitude",
    "rest api", "graphql", "api", "web scraping",
    "ci/cd", "jenkins", "github actions",
    "linux", "bash", "shell scripting",
)

SOFT_SKILLS = (
    "communication", "stakeholder management", "presentation",
    "problem solving", "critical thinking", "teamwork",
    "agile", "scrum", "leadership", "time management",
    "analytical thinking", "attention to detail",
    "cross-functional collaboration", "storytelling",
    "project management", "self-motivated", "adaptable",
)

BUSINESS_SKILLS = (
    "salesforce", "hubspot", "zendesk", "intercom", "freshdesk",
    "servicenow", "pipedrive", "zoho", "gong", "outreach", "salesloft",
    "zoominfo", "apollo", "live chat", "help scout", "jira service management",
    "csat", "nps", "sla", "customer onboarding", "customer retention",
    "customer success", "customer support", "customer service",
    "customer experience", "ticketing", "escalation management",
    "first response time", "voice of customer", "churn",
    "crm", "lead generation", "lead gen", "prospecting", "cold calling",
    "cold outreach", "cold email", "outbound", "inbound", "b2b sales",
    "pipeline management", "account management", "upselling", "cross-selling",
    "negotiation", "demand generation", "sales development", "quota attainment",
)

SKILL_CATEGORIES = {
    "sql": "database", "postgresql": "database", "mysql": "database",
    "snowflake": "database", "bigquery": "database", "redshift": "database",
    "databricks": "database", "mongodb": "database", "redis": "database",
    "excel": "spreadsheet", "google sheets": "spreadsheet",
    "python": "programming", "r": "programming", "javascript": "programming",
    "sas": "programming", "java": "programming",
    "tableau": "bi_tool", "power bi": "bi_tool", "looker": "bi_tool",
    "mode": "bi_tool", "metabase": "bi_tool",
    "aws": "cloud", "gcp": "cloud", "azure": "cloud", "google cloud": "cloud",
    "docker": "devops", "kubernetes": "devops", "git": "devops",
    "airflow": "orchestration", "dbt": "transformation",
    "spark": "big_data", "hadoop": "big_data", "kafka": "streaming",
    "pandas": "data_analysis", "numpy": "data_analysis",
    "machine learning": "ml", "deep learning": "ml",
    "tensorflow": "ml", "pytorch": "ml", "scikit-learn": "ml",
    "salesforce": "crm", "hubspot": "crm", "pipedrive": "crm", "zoho": "crm",
    "zendesk": "support_tool", "intercom": "support_tool",
    "freshdesk": "support_tool", "help scout": "support_tool",
    "csat": "cx_metric", "nps": "cx_metric", "sla": "cx_metric",
    "lead generation": "sales", "prospecting": "sales", "cold outreach": "sales",
    "pipeline management": "sales", "account management": "sales",
    "customer success": "customer_success", "customer support": "customer_support",
}

REQUIRED_MARKERS = ("required", "must have", "essential", "minimum", "qualifications")

# --- Fixed values: role taxonomy, in priority order ---------------------------

ROLE_KEYWORDS = {
    "analytics": (
        "data analyst", "data analytics", "analytics analyst", "business analyst",
        "product analyst", "analytics engineer", "data engineer", "bi analyst",
        "bi developer", "business intelligence", "reporting analyst",
        "insights analyst", "data scientist", "decision scientist", "ml engineer",
        "revenue analyst", "marketing analyst", "operations analyst",
        "commercial analyst", "financial analyst", "risk analyst",
    ),
    "business_development": (
        "business development", "business developer", "bd analyst",
        "bd representative", "sales development", "sdr", "bdr",
        "partnerships analyst", "partnership analyst", "partnerships associate",
        "growth analyst", "market research analyst", "commercial development",
    ),
    "customer_service": (
        "customer service", "customer support", "customer success",
        "customer experience", "customer care", "customer advisor",
        "client support", "client service", "client services",
        "support specialist", "support agent", "support representative",
        "support analyst", "help desk", "helpdesk", "service desk",
        "technical support", "csr",
    ),
}

# --- Fixed values: discovery filters ------------------------------------------

IRRELEVANT_TITLE_WORDS = (
    "caretaker", "housekeeper", "cleaner", "driver", "warehouse",
    "cashier", "bartender", "cook", "chef", "construction",
    "laborer", "mechanic", "electrician", "plumber", "nurse",
    "caregiver", "security guard", "janitor", "landscaping",
    "courier", "packer", "assembly", "factory", "welder",
)

SENIOR_TITLE_WORDS = (
    "senior", "sr.", "sr ", "lead", "principal", "staff",
    "director", "vp", "head of", "chief", "manager",
)

ENTRY_TITLE_WORDS = (
    "junior", "jr", "entry", "graduate", "intern", "associate",
    "trainee", "starter", "beginner", "0-3", "0-2", "0-1",
    "entry-level", "entry level",
)

ENTRY_LEVELS = ("internship", "graduate", "entry-level", "associate", "junior", "0-3 years")

REMOTE_WORDS = ("remote", "worldwide", "anywhere", "global", "eu", "emea")

TARGET_LOCATIONS = (
    "United States", "United Kingdom", "Germany", "Netherlands",
    "Ireland", "France", "Belgium", "Sweden", "Norway", "Denmark",
    "Finland", "Switzerland", "Austria", "Spain", "Portugal",
    "Italy", "Poland", "Czech Republic", "Luxembourg",
    "Estonia", "Lithuania", "Latvia",
)

# --- Fixed values: validation ---------------------------------------------------

SCAM_PHRASES = (
    "make money fast", "work from home guaranteed",
    "no experience needed", "earn $", "wire transfer",
    "send money", "pay upfront", "mlm", "pyramid",
    "crypto investment", "binary options",
)

STAFFING_PHRASES = (
    "staffing", "staffing agency", "recruitment agency",
    "talent solutions", "human resources solutions",
    "consulting group", "workforce solutions",
)

# --- Fixed values: field normalisation ------------------------------------------

COUNTRY_ALIASES = {
    "usa": "United States", "u.s.": "United States",
    "us": "United States", "uk": "United Kingdom",
    "u.k.": "United Kingdom", "deutschland": "Germany",
    "nl": "Netherlands", "ie": "Ireland",
}

TITLE_PREFIXES = (
    "junior ", "jr. ", "jr ", "sr. ", "senior ", "sr ", "lead ", "principal ", "staff ",
)

# Work-mode suffix after a dash, and a trailing parenthesis.
TITLE_SUFFIX_WORDS = r"Remote|Hybrid|Onsite|Full.?time|Part.?time"
COMPANY_SUFFIX = r",?\s*Inc\.?$|,\s*LLC\.?$|,\s*Ltd\.?$"

# Free-text location -> country, first contained key wins (order matters).
LOCATION_COUNTRIES = {
    "united states": "United States", "usa": "United States",
    "us": "United States", "uk": "United Kingdom",
    "united kingdom": "United Kingdom", "germany": "Germany",
    "netherlands": "Netherlands", "ireland": "Ireland",
    "france": "France", "spain": "Spain", "sweden": "Sweden",
    "norway": "Norway", "denmark": "Denmark", "finland": "Finland",
}

# Two-letter country codes of the code-based board.
COUNTRY_CODES = {
    "us": "United States", "gb": "United Kingdom", "de": "Germany",
    "nl": "Netherlands", "ie": "Ireland", "fr": "France",
    "be": "Belgium", "se": "Sweden", "no": "Norway", "dk": "Denmark",
    "fi": "Finland", "ch": "Switzerland", "at": "Austria",
    "es": "Spain", "pt": "Portugal", "it": "Italy", "pl": "Poland",
    "cz": "Czech Republic", "lu": "Luxembourg",
}

# --- Fixed values: seniority words per board (substring of the lowercased title) --

LEVEL_WORDS = {
    "remotive": ("senior", "sr", "lead", "principal"),
    "greenhouse": ("senior", "sr", "lead", "principal"),
    "lever": ("senior", "sr", "lead", "principal"),
    "ashby": ("senior", "sr", "lead"),
    "smartrecruiters": ("senior", "sr", "lead"),
    "adzuna": ("senior", "sr", "lead"),
    "eu_startup_jobs": ("senior", "sr", "lead"),
    "indeed": ("senior", "sr", "lead"),
    "workday": ("senior", "sr", "lead"),
    "linkedin": ("senior", "sr ", "lead", "principal", "staff"),
}
REMOTEOK_LEVEL_WORDS = (
    ("Entry-Level", ("junior", "jr", "entry", "graduate", "intern")),
    ("Senior", ("senior", "sr", "lead", "principal")),
    ("Mid-Level", ("mid", "intermediate")),
)

SOURCE_CAPS = {"linkedin": 150, "welcometothejungle": 120}

# --- Fixed values: advice texts ---------------------------------------------------

LEARNING_PATHS = {
    "sql": "Complete SQL fundamentals on Mode Analytics or SQLZoo",
    "python": "Take Python for Data Science on DataCamp or Coursera",
    "tableau": "Complete Tableau Public training and build 3 dashboards",
    "power bi": "Take Microsoft Power BI learning path on Microsoft Learn",
    "excel": "Master Excel pivot tables and advanced formulas",
    "aws": "Get AWS Cloud Practitioner certification",
    "docker": "Complete Docker fundamentals on Docker's official training",
    "git": "Learn Git branching and collaboration workflows",
    "machine learning": "Take Andrew Ng's ML course on Coursera",
    "airflow": "Build ETL pipelines with Apache Airflow",
    "dbt": "Learn analytics engineering with dbt",
    "spark": "Complete Databricks Community Edition tutorials",
}

LEARNING_HINTS = {
    "sql": "Practice complex queries on LeetCode or HackerRank",
    "python": "Build 3 data analysis projects with pandas",
    "tableau": "Create a public Tableau portfolio with 5+ dashboards",
    "power bi": "Complete Microsoft's PL-300 learning path",
    "excel": "Master advanced formulas and pivot tables",
    "docker": "Containerize a data pipeline project",
    "git": "Practice branching and PR workflows",
    "spark": "Build a distributed data processing project",
    "airflow": "Create an ETL DAG with error handling",
    "dbt": "Build a dbt project with tests and documentation",
}

ADVICE_ADD_SKILLS = "Add these skills to your resume if you have them: "
ADVICE_NO_VISA = "Consider highlighting your ability to work independently across time zones"
ADVICE_ALWAYS = "Tailor your resume keywords to match this job description"
