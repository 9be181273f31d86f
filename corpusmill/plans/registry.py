"""All named queries of the core, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans import core, reports, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**core.QUERIES, **search.QUERIES, **reports.QUERIES}
ORACLE: dict[str, str] = {**core.ORACLE, **search.ORACLE, **reports.ORACLE}

#: Columns whose SQL type is another than the query's.
AS_INT = {"o23_token_counts": ["n"], "r01_dense_top_k": ["rank"], "r21_filtered_dense": ["rank"], "r02_sparse_top_k": ["rank"], "r03_fusion": ["rank"], "a18_fusion_report": ["first_dropped_dense", "first_dropped_sparse"], "r04_query_pool": ["rank"], "p04_themes": ["position"], "p06_page_text": ["chars"], "p26_missing_postings": ["chars"], "r20_listing": ["n"], "r11_template_top_k": ["rank"], "r12_asset_top_k": ["rank"]}
AS_BIGINT = {"a11_host_report": ["chars"], "a12_url_report": ["chars"], "a13_block_report": ["chars", "table_rows", "rows_lost"], "a16_gate_summary": ["errors"]}
#: Instants are compared as microseconds, local times as text, so that no session time zone matters.
INSTANTS = {"s12_latest_pages": ["arrived_at"], "j04_orphan_hits": ["newest"], "s12_upsert": ["arrived_at"]}
LOCAL_TIMES = {"t03_lease_spans": ["held_from", "held_until"], "t03_lease_stream": ["held_from", "held_until"], "t06_latest_status": ["ts"]}


def _recast(name: str, columns: list[str], form: str) -> None:
    ORACLE[name] = f"select * replace ({', '.join(form.format(c) + ' as ' + c for c in columns)}) from ({ORACLE[name]}) t"


def _as(fn: Callable[[SparkSession, str], DataFrame], columns: list[str], change: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: fn(s, d).withColumns({c: change(c) for c in columns})


for _n, _c in AS_INT.items():
    _recast(_n, _c, "cast({} as int)")
for _n, _c in AS_BIGINT.items():
    _recast(_n, _c, "cast({} as bigint)")
for _n, _c in INSTANTS.items():
    _recast(_n, _c, "epoch_us({})")
    QUERIES[_n] = _as(QUERIES[_n], _c, F.unix_micros)
for _n, _c in LOCAL_TIMES.items():
    _recast(_n, _c, "strftime({}, '%Y-%m-%d %H:%M:%S.%f')")
    QUERIES[_n] = _as(QUERIES[_n], _c, lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["p01_index_run"](spark, sf_dir)
