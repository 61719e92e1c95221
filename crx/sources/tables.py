"""Fixed schemas and column defaults for the six persistent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_S = T.StringType()
_L = T.LongType()
_I = T.IntegerType()
_D = T.DoubleType()
_B = T.BooleanType()
_TS = T.TimestampNTZType()
_AS = T.ArrayType(T.StringType())


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    "repositories": _schema(
        ("id", _L), ("github_repo_id", _L), ("name", _S), ("full_name", _S),
        ("owner", _S), ("html_url", _S), ("default_branch", _S), ("language", _S),
        ("created_at", _TS), ("updated_at", _TS)),
    "pull_requests": _schema(
        ("id", _L), ("repository_id", _L), ("pr_number", _L), ("title", _S),
        ("body", _S), ("author", _S), ("head_sha", _S), ("base_sha", _S),
        ("head_branch", _S), ("base_branch", _S), ("diff_url", _S),
        ("created_at", _TS), ("updated_at", _TS)),
    "review_records": _schema(
        ("id", _L), ("pull_request_id", _L), ("status", _S), ("summary", _S),
        ("critical_count", _I), ("warning_count", _I), ("suggestion_count", _I),
        ("total_issues", _I), ("triggered_by", _S), ("error_message", _S),
        ("started_at", _TS), ("completed_at", _TS), ("created_at", _TS)),
    "review_issues": _schema(
        ("id", _L), ("review_record_id", _L), ("file_path", _S), ("line_start", _I),
        ("line_end", _I), ("severity", _S), ("category", _S), ("rule_id", _S),
        ("title", _S), ("description", _S), ("suggestion", _S),
        ("suggestion_diff", _S), ("confidence", _D), ("source", _S),
        ("created_at", _TS)),
    "repo_configs": _schema(
        ("repository_id", _L), ("auto_review", _B), ("enabled_categories", _AS),
        ("ignore_patterns", _AS), ("ignore_rule_ids", _AS), ("review_language", _S),
        ("max_files_per_review", _I), ("confidence_threshold", _D),
        ("created_at", _TS), ("updated_at", _TS)),
    "users": _schema(
        ("github_user_id", _L), ("login", _S), ("avatar_url", _S), ("is_admin", _B),
        ("last_login_at", _TS), ("created_at", _TS)),
}

# Column defaults of the persistent tables.
DEFAULTS: dict[str, dict[str, object]] = {
    "repositories": {"default_branch": "main"},
    "review_records": {"status": "pending", "critical_count": 0, "warning_count": 0,
                       "suggestion_count": 0, "total_issues": 0},
    "review_issues": {"confidence": 0.0, "source": "ai"},
    "repo_configs": {"auto_review": True, "review_language": "zh-CN",
                     "max_files_per_review": 50, "confidence_threshold": 0.6},
    "users": {"is_admin": False},
}


def conform(name: str, df: DataFrame) -> DataFrame:
    """Project `df` onto the fixed schema of table `name` (missing columns become
    null), cast every column, then fill the column defaults."""
    schema = SCHEMAS[name]
    defaults = DEFAULTS.get(name, {})
    present = set(df.columns)
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Scan `<path>/<table>.parquet` for the six tables with fixed schemas and
    defaults applied. Missing tables are skipped."""
    out = {}
    for name, schema in SCHEMAS.items():
        file = f"{path}/{name}.parquet"
        if _exists(spark, file):
            out[name] = conform(name, spark.read.schema(schema).parquet(file))
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists; errors other than absence (rights, storage) are raised."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
