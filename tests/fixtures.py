"""Hand-made source rows for boundary tests (as_of = 2026-05-19)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from tidemark.sources.registry import Sources
from tidemark.sources.schemas import SOURCE_SCHEMAS

AS_OF = dt.date(2026, 5, 19)


def days_ago(n: int) -> dt.date:
    return AS_OF - dt.timedelta(days=n)


def ts_ago(n: int, hour: int = 12) -> dt.datetime:
    d = days_ago(n)
    return dt.datetime(d.year, d.month, d.day, hour)


def table(spark: SparkSession, role: str, rows: list[dict]):
    schema = SOURCE_SCHEMAS[role]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def sources(spark: SparkSession, **roles: list[dict]) -> Sources:
    return Sources(**{name: table(spark, name, roles.get(name, [])) for name in SOURCE_SCHEMAS})


def account(id_, **kw) -> dict:
    base = {"id": id_, "name": f"Acct {id_}", "type": "Customer",
            "active_product_lines_c": "Angles Professional", "customer_success_associate_c": "u1",
            "platform_legacy_id_c": id_, "_fivetran_deleted": False}
    base.update(kw)
    return base


def customer(cid, sfdc, **kw) -> dict:
    base = {"customerid": cid, "customername": f"Cust {cid}", "salesforceid": sfdc, "webid": str(cid),
            "onmaintenance": True, "_fivetran_deleted": False}
    base.update(kw)
    return base
