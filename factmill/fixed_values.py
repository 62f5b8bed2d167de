"""Words, labels, bounds and pools that results must agree on.

Everything in this module is data, given as plain text; the logic that uses it
lives elsewhere and takes each of these as a parameter.
"""

# Texts that stand for "no value" in a critical column.
NULL_TOKENS = (
    "",
    "NULL",
    "null",
    "None",
    "Unknown",
    "unknown",
    "N/A",
    "n/a",
    "NaN",
)

# District spellings restored after title casing.
DISTRICT_CORRECTIONS = {
    "City Of London": "City of London",
    "Kensington And Chelsea": "Kensington and Chelsea",
    "Hammersmith And Fulham": "Hammersmith and Fulham",
    "Barking And Dagenham": "Barking and Dagenham",
}

# Validity bounds, outlier fences and report quantiles.
YEAR_MIN = 2000
MONTH_MIN = 1
MONTH_MAX = 12
IQR_FACTOR = 1.5
Z_LIMIT = 3.0
QUARTILE_LOW = 0.25
QUARTILE_HIGH = 0.75
REPORT_LOW = 0.05
REPORT_HIGH = 0.95

# Load, page and snapshot settings.
LOAD_BATCH = 1_000
PAGE_ROWS = (25, 50, 100)
SNAPSHOT_CODEC = "snappy"
SNAPSHOT_FORMATS = ("parquet", "csv")
HISTORY_RUNS = 5
LOG_SCHEMA_VERSION = "1.0"

# Model settings.
RANDOM_SEED = 42
TRAIN_UNTIL = 2014
LOGREG_MAX_ITER = 1000
FOREST_TREES = 80
FOREST_MIN_LEAF = 3
DECISION_THRESHOLD = 0.5

# Parameters of the generated sample table.
SAMPLE_ROWS = 150
SAMPLE_SEED = 42
SAMPLE_MEAN = 15
SAMPLE_YEARS = (2008, 2009, 2010, 2011, 2012, 2013, 2014, 2015, 2016)
SAMPLE_AREA_START = 1
SAMPLE_AREA_STOP = 200

# The sample districts.
SAMPLE_DISTRICTS = (
    "City of London",
    "Westminster",
    "Camden",
    "Islington",
    "Hackney",
    "Tower Hamlets",
    "Greenwich",
    "Lewisham",
    "Southwark",
    "Lambeth",
    "Wandsworth",
    "Hammersmith and Fulham",
    "Kensington and Chelsea",
    "Brent",
    "Ealing",
    "Hounslow",
    "Richmond upon Thames",
    "Kingston upon Thames",
    "Merton",
    "Sutton",
    "Croydon",
    "Bromley",
    "Bexley",
    "Havering",
    "Barking and Dagenham",
    "Redbridge",
    "Newham",
    "Waltham Forest",
    "Haringey",
    "Enfield",
    "Barnet",
    "Harrow",
    "Hillingdon",
)

# The sample categories, major to minor.
SAMPLE_CATEGORIES = {
    "Burglary": ("Burglary in a dwelling", "Burglary in other buildings"),
    "Criminal Damage": ("Criminal damage to a vehicle", "Other criminal damage"),
    "Drugs": (
        "Possession of cannabis",
        "Possession of class A drugs",
        "Other drug offences",
    ),
    "Robbery": ("Robbery of business property", "Robbery of personal property"),
    "Sexual Offences": ("Rape", "Sexual assault", "Other sexual offences"),
    "Theft and Handling": (
        "Pickpocketing",
        "Shoplifting",
        "Theft from a vehicle",
        "Theft of a vehicle",
        "Other theft",
    ),
    "Violence Against the Person": (
        "Assault with injury",
        "Assault without injury",
        "Harassment",
        "Murder",
    ),
    "Fraud or Forgery": ("Fraud", "Forgery or use of false instrument"),
    "Other Notifiable Offences": ("Other notifiable offences",),
}

# Tags of the combined export, and run modes.
TAG_DISTRICTS = "Crímenes por Distrito"
TAG_TOP_MINORS = "Top 10 Subcategorías"
TAG_TREND = "Tendencia Temporal (Mes a Mes)"
MODE_DEMO = "Demo"
MODE_PRODUCTION = "Produccion"
STABLE = "Estable"
UNSTABLE = "Revisar"
UNAVAILABLE = "No disponible"

# Stage names of a run and of the statistics document.
STAGE_INGEST = "ingesta"
STAGE_CLEAN = "limpieza"
STAGE_VALIDATE = "validacion"
STAGE_SAVE = "guardado"
STAGE_LOAD = "carga"
STAT_RAW = "crudos"
STAT_AGGREGATED = "agregacion"
STAT_TOTAL = "total_crimenes"
