"""Declared schemas. Missing optional columns become typed nulls on ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
BOOL, TIME, STRINGS = T.BooleanType(), T.TimestampType(), T.ArrayType(T.StringType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LANDING = struct(source=STRING, context=STRING, payload=STRING, ingest_seq=LONG, landed_at=TIME)

POSTING_FIELDS = struct(
    source=STRING, external_id=STRING, title=STRING, company=STRING, url=STRING, apply_url=STRING,
    description=STRING, country=STRING, city=STRING, remote_type=STRING, salary_min=INT, salary_max=INT,
    salary_currency=STRING, experience_level=STRING, employment_type=STRING, visa_sponsorship=BOOL,
    international_hiring=BOOL, relocation_support=BOOL, posting_date=TIME, closing_date=TIME,
    role_category=STRING, raw_data=STRING,
)

#: Arrival number of a posting that came out of a payload.
ARRIVAL = T.DecimalType(30, 0)
POSTING_RAW = T.StructType(POSTING_FIELDS.fields + struct(ingest_seq=LONG).fields)

SKILL_HITS = T.ArrayType(struct(name=STRING, category=STRING, is_required=BOOL, count=INT))

USERS = struct(user_id=LONG, skills=STRINGS, experience_years=INT, target_role=STRING)

PROJECTS = struct(
    role_category=STRING, catalog_order=INT, title=STRING, industry=STRING, business_problem=STRING,
    dataset_source=STRING, dataset_url=STRING, skills=STRINGS, difficulty=STRING, estimated_hours=INT,
    description=STRING, key_tasks=STRINGS, resume_bullets=STRINGS,
)

STORED_KEYS = struct(source=STRING, external_id=STRING)

STORED_COMPANIES = struct(company_id=STRING, normalized_name=STRING, name=STRING, industry=STRING, first_seq=ARRIVAL)

#: Rejected on the way to the store: what, why, and what is known of it.
REJECTS = struct(
    ingest_seq=ARRIVAL, source=STRING, external_id=STRING, title=STRING, posting_date=TIME, reasons=STRINGS,
)

RUN_LOG = struct(
    run_id=STRING, started_at=TIME, completed_at=TIME, status=STRING, jobs_found=LONG,
    jobs_validated=LONG, jobs_rejected=LONG, metadata=STRING,
)

# Values a posting takes when a board does not state the field.
DEFAULTS = {
    "remote_type": "unknown",
    "employment_type": "unknown",
    "visa_sponsorship": False,
    "international_hiring": False,
    "relocation_support": False,
}


def posting_struct(**columns: Column) -> Column:
    """One posting as a struct in canonical field order; absent fields get their default."""
    unknown = set(columns) - set(POSTING_FIELDS.names)
    if unknown:
        raise ValueError(f"not posting fields: {sorted(unknown)}")
    return F.struct(
        *[
            columns.get(f.name, F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name)
            for f in POSTING_FIELDS.fields
        ]
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select ``schema``'s columns, adding missing ones as typed nulls."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
