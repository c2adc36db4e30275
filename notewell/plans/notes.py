"""Views that the queries run on: clinical notes and review tables, derived from the driver's tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOTES = """select event_id as note_id, user_id as patient_id, ts,
 concat('Patient ', cast(user_id as string), ' prescribed ',
  case event_id % 6 when 0 then 'aspirin' when 1 then 'ibuprofen' when 2 then 'amlodipine'
       when 3 then 'atorvastatin' when 4 then 'omeprazole' else 'amoxicillin' end, ' ',
  cast((1 + user_id % 10) * 50 as string), 'mg ',
  case event_type when 'view' then 'BD' when 'click' then 'OD' when 'signup' then 'TDS'
       when 'error' then '1-0-1' else 'PRN' end,
  ' for ', cast(1 + event_id % 14 as string), ' days. ',
  case event_id % 5 when 0 then 'Reports chest pain. ' when 1 then 'MRN: 10042. '
       when 2 then 'DOB: 01/02/1980. ' when 3 then 'History of hypertension. '
       else 'SSN 123-45-6789. ' end) as text
from events"""

#: Notes with a second drug, OCR damage, leaked labels, contacts and addresses.
DAMAGED = f"""select note_id, patient_id, ts, concat(text,
  case note_id % 9 when 0 then 'Also zee dol 100mg at night. ' when 1 then 'Take 10ny of p hexin x BD for 5days. '
       when 2 then 'coughDISEASE and fever, StrengthDrug noted. ' when 3 then 'Mail jane.roe@example.org or 555-123-4567. '
       when 4 then 'Lives at 12 Oak Street, 90210. ' when 5 then '2 tablets 1 - 0 - 1 x 5 days, mild Asthma since weeks ago. '
       when 6 then 'Insulin glargine 10 units qhs for 2 weeks, q8h prn. ' when 7 then 'Seen by Dr John Smith on 03/04/2021. '
       else 'two times daily days days Syrup 5 ml ' end) as text
from ({NOTES}) n"""

#: Exploded entities of notes by fixed offsets of a literal form, for operators on spans.
ENTITIES = """select event_id as doc_id, cast(event_id % 7 as int) as k,
  case event_id % 12 when 0 then 'Aspirin' when 1 then '500 mg' when 2 then '2 tablets' when 3 then '500freq' when 4 then '1 - 0 - 1 x 5'
   when 5 then '5 days' when 6 then '1-0-1' when 7 then 'oral' when 8 then 'syrup' when 9 then 'qs' when 10 then 'bcdfg' else 'tablet ibuprofen' end as text,
  case event_id % 12 when 0 then 'DRUG' when 7 then 'FORM' when 8 then 'DRUG' when 9 then 'DRUG' when 10 then 'DISEASE' when 11 then 'DRUG'
   else case event_id % 3 when 0 then 'DOSAGE' when 1 then 'STRENGTH' else 'ROUTE' end end as label,
  cast(event_id % 40 as int) as start, cast(event_id % 40 + 8 as int) as "end", cast((event_id % 11) as double) / 10.0 as score
 from events"""

REVIEW = """select o_orderkey as id, case o_orderstatus when 'O' then 'pending' when 'F' then 'verified' else 'flagged' end as status,
  o_orderdate as created_at, cast((o_orderkey % 97) as double) / 97.0 as score, cast(o_custkey % 12 as int) as n_entities
 from orders"""


def sql_for_spark(text: str) -> str:
    return text.replace('"end"', "`end`")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view's DataFrame; its source table is named in its text."""
    for name in ("events", "orders", "documents", "conversations", "customer", "part", "lineitem"):
        if f"from {name}" in text:
            return spark.sql(sql_for_spark(text).replace(f"from {name}", "from {" + name + "}"), **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet")})
    raise ValueError("no known table")
