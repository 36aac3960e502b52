"""Values that decide results. All of them are defaults: every operator takes its list as a parameter."""

# --- fixed values -----------------------------------------------------------------------------

SCRIPT_EXTENSIONS = ["sql", "sh", "py"]

# A line holding one of these is set-up code.
BOILERPLATE_TOKENS = [
    "import ", "appName(", ".config(", ".getArgs", "ArgumentParser", "SparkSession",
    "os.path.basename", "result_data", "set hive.", "job_rslt_cd", "job_st_dtm", "fail_message",
    ".setDevLog", "writeStartExecLog", ".builder", "enableHiveSupport", "getOrCreate", "print(",
    "except Exception", "finally:", "exit(0)", "else:", "try:", "add jar",
    "create temporary function",
]

# A line whose upper case holds one of these is job control.
JOB_CONTROL_TOKENS = ["SPARK.STOP()", ".WRITEDEVLOG", "JOB_END_DTM", "SPARK.UDF."]

# Text removed from every line.
CONFIG_PREFIXES = ["_lower()}", "CommonCfg.", "MartCfg.", "DwCfg."]

# Prefixes removed from a path-like assignment value (V2).
VALUE_PREFIXES = ["DwCfg.", "MartCfg.", "Common."]

# An upper-cased line holding one of these is no assignment (V1).
NOT_ASSIGNMENT_TOKENS = ["WHERE ", "ON ", "AND", "CASE ", "WHEN ", "END", "SAVE_DIR", "READ.PARQUET"]

# A line that starts `df_` and holds one of these opens a block owned by that variable.
OPENING_TOKENS = [
    "spark.sql", "spark.read.parquet", "createOrReplaceTempView", "save", ".union(", ".write.mode(",
]

# The one schema name that keeps its underscore.
WHOLE_SCHEMA = "IP_PLF"

# Known schemas.
KNOWN_SCHEMAS = [
    "ABL", "ABZ", "ACC", "ACO", "ACP", "ACR", "ACS", "ACT", "AEX", "AID", "AIP", "ANW", "AST",
    "ASWG", "BCM", "BCR", "BDWSOR", "BIDM", "BIDW", "BIODS", "BMR", "BMT", "BSM", "BSW", "BTVPLUS",
    "CDC", "CDR", "CEI", "COM", "CYBERCS", "EXT", "FOMS", "ICT", "ICTANLY", "ICTFAMILY", "ICTFIN",
    "IP_PLF", "KDMC", "PODS", "PROM", "RACE", "RTN", "RWK", "SAP", "SKA", "SKT", "SMS", "SSONE",
    "STG", "STG_CATV", "SWG", "SWR", "TAS", "TBMT", "TCM", "TDBM", "TDBR", "TEMPVIEW", "TMP",
    "TSDR", "TVPS", "VCP",
]

# Schema prefixes that are never tables.
REJECTED_SCHEMA_PREFIXES = ["TAST"]

# Schemas of the statement-level membership split (Q11).
STATEMENT_SCHEMAS = [
    "ABL", "ACC", "ACO", "ACP", "ACT", "ADH", "BCM", "BCR", "BDWSOR", "BMT", "CDR", "RSLT", "RTN",
    "SMS", "SWG", "TAS", "TBMT", "TMP",
]

# --- sizes ------------------------------------------------------------------------------------

# A script of at most this many source lines is one window partition. A longer one is cut into
# chunks of this many lines, and state is carried from chunk to chunk (operators/scan.py).
CHUNK_LINES = 16384

# A task holds about this many lines of scripts; the map sorts its rows several times.
LINES_A_TASK = 1 << 17

# Script files are read in ranges of this many bytes, and a task reads about as many.
RANGE_BYTES = 64 << 20
