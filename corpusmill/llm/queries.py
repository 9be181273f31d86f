"""The queries of this subpackage over the tables of one folder, and SQL equivalents where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.sites import SITE_PATTERN, site
from corpusmill.llm.furniture import furniture, main_blocks
from corpusmill.llm.leaks import leaks
from corpusmill.llm.mixing import mix
from corpusmill.llm.neardup import all_pairs, classes, near_duplicates
from corpusmill.llm.residue import residue
from corpusmill.llm.site_lines import remove_repeated_lines, repeated_lines
from corpusmill.llm.split import split_items, split_oversized
from corpusmill.llm.stuffing import stuffed
from corpusmill.llm.topn import top_n

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(_table(spark, sf_dir, "page_hits"), "page_id", "score", "hit_id", 3).select("page_id", "hit_id")


QUERIES["p1_found"] = p1_found
ORACLE["p1_found"] = """
with h as (select distinct page_id, hit_id, score from page_hits
           where page_id is not null and hit_id is not null and score is not null and not isnan(score))
select page_id, hit_id from (
  select page_id, hit_id, row_number() over (partition by page_id order by score desc, hit_id) as rn from h) t
where rn <= 3
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(_table(spark, sf_dir, "crawl_pages"), "page_id", site("origin"), "blocks", 5)


QUERIES["p3_found"] = p3_found
ORACLE["p3_found"] = f"""
with p as (select distinct page_id, regexp_extract(lower(origin), '{SITE_PATTERN}', 1) as site, blocks from crawl_pages),
b as (select page_id, site, unnest(blocks) as b, unnest(range(len(blocks))) as block_pos from p where len(blocks) > 0),
t as (select page_id, site, block_pos, string_split(b.text, chr(10)) as ls from b where b.kind <> 'code' and b.text is not null),
l as (select page_id, site, block_pos, unnest(ls) as line, unnest(range(len(ls))) as line_no from t),
k as (select page_id, site, block_pos, line_no, regexp_replace(lower(line), '[^\\p{{L}}]+', '', 'g') as key from l),
g as (select site, key from k where key <> '' group by site, key having count(distinct page_id) >= 5)
select distinct page_id, cast(block_pos as int) as block_pos, cast(line_no as int) as line_no from k join g using (site, key)
"""


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that are left when the repeated lines are taken out of every page."""
    pages = remove_repeated_lines(_table(spark, sf_dir, "crawl_pages"), "page_id", site("origin"), "blocks", 5)
    return pages.select("page_id", F.posexplode("blocks").alias("block_pos", "b")).select("page_id", "block_pos", F.col("b.text").alias("text")).where("text is not null").distinct()


QUERIES["p3_clean"] = p3_clean
ORACLE["p3_clean"] = f"""
with p as (select distinct page_id, regexp_extract(lower(origin), '{SITE_PATTERN}', 1) as site, blocks from crawl_pages where page_id is not null),
b as (select page_id, site, unnest(blocks) as b, unnest(range(len(blocks))) as block_pos from p where len(blocks) > 0),
t as (select page_id, site, block_pos, b.kind = 'code' as code, b.text as text, string_split(b.text, chr(10)) as ls from b where b.text is not null),
l as (select page_id, site, block_pos, code, text, unnest(ls) as line, unnest(range(len(ls))) as line_no from t),
k as (select *, case when code then '' else regexp_replace(lower(line), '[^\\p{{L}}]+', '', 'g') end as key from l),
g as (select site, key from k where key <> '' and site is not null group by site, key having count(distinct page_id) >= 5)
select distinct page_id, cast(block_pos as int) as block_pos, case when code then text else coalesce(string_agg(line, chr(10) order by line_no) filter (where g.key is null), '') end as text
from k left join g using (site, key) group by page_id, site, block_pos, code, text
"""


def p5_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the units within the limit of children: the pieces of the oversized ones, the others whole."""
    return split_items(_table(spark, sf_dir, "parent_child_units"), ["unit_id"], "child_text", 200, 40).select("unit_id", "text_hash", "piece", "n_tokens")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces themselves, of all three fields."""
    sections, units = _table(spark, sf_dir, "block_sections"), _table(spark, sf_dir, "parent_child_units")
    parts = []
    for field, df, idx, text, limit, overlap in (("section", sections, "section_index", "text", 500, 80), ("parent", units, "parent_index", "parent_text", 500, 80), ("child", units, "child_index", "child_text", 200, 40)):
        parts.append(split_oversized(df, ["page_id", idx], text, limit, overlap).withColumnRenamed(idx, "idx").withColumn("field", F.lit(field)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("piece = 1").select("field", "page_id", "idx").distinct()


QUERIES["p5_found"] = p5_found
QUERIES["p5_pieces"] = p5_pieces
QUERIES["p5_all"] = p5_all
_TOKENS = r"len(regexp_extract_all({0}, '[\pL\pN_]+|[^\pL\pN_\s\x1c-\x1f\x85\pZ]'))"
ORACLE["p5_found"] = f"""
select distinct 'section' as field, page_id, section_index as idx from block_sections where {_TOKENS.format("text")} > 500
union select distinct 'parent', page_id, parent_index from parent_child_units where {_TOKENS.format("parent_text")} > 500
union select distinct 'child', page_id, child_index from parent_child_units where {_TOKENS.format("child_text")} > 200
"""


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed(_table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


QUERIES["p9_found"] = p9_found


def p7_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 12 words of an item but for at most two edited characters."""
    return leaks(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "eval_items"), "item_id", "text", 12, 2)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of these, the ones that hold them word for word."""
    return p7_edited(spark, sf_dir).where("edits = 0").select("doc_id", "item_id")


QUERIES["p7_found"] = p7_found
QUERIES["p7_edited"] = p7_edited
_SHINGLES = "select {0}, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda k: array_to_string(w[k:k + 11], ' '))) as s from (select {0}, regexp_extract_all(lower(text), '[\\pL\\pN]+') as w from {1} where text is not null) where len(w) >= 12"
ORACLE["p7_found"] = f"""
with d as ({_SHINGLES.format("doc_id", "documents")}), i as ({_SHINGLES.format("item_id", "eval_items")})
select distinct doc_id, item_id from d join i using (s)
"""


def _p2(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    text = F.array_join(F.transform("blocks", lambda b: F.concat_ws(" ", b["text"], F.array_join(b["cells"], " "))), "\n")
    pages = _table(spark, sf_dir, "crawl_pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("key"), text.alias("text"))
    units = _table(spark, sf_dir, "parent_child_units").select(F.lit("unit").alias("kind"), F.col("unit_id").alias("key"), F.col("child_text").alias("text"))
    return near_duplicates(pages.unionByName(units), {"page": 100, "unit": 40}, 0.75)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(*_p2(spark, sf_dir)).withColumnRenamed("kind", "record_kind")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(*_p2(spark, sf_dir))


QUERIES["p2_found"] = p2_found
QUERIES["p2_classes"] = p2_classes


def _p8(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(_table(spark, sf_dir, "documents"), "doc_id", "text", "source", _table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir)[1]


def p8_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares when the natural ones are tempered as far towards equal ones as the repetition limits allow."""
    return mix(_table(spark, sf_dir, "documents"), "doc_id", "text", "source", _table(spark, sf_dir, "mix_targets"), temperature=True)[1]


def p8_tempered_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of that mix."""
    return mix(_table(spark, sf_dir, "documents"), "doc_id", "text", "source", _table(spark, sf_dir, "mix_targets"), temperature=True)[0]


def p8_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares when the natural ones are tempered to an entropy of 2.2 nats, as far as the repetition limits allow."""
    return mix(_table(spark, sf_dir, "documents"), "doc_id", "text", "source", _table(spark, sf_dir, "mix_targets"), target_entropy=2.2, temperature=True)[1]


QUERIES["p8_mix"] = p8_mix
QUERIES["p8_tempered_mix"] = p8_tempered_mix
QUERIES["p8_entropy"] = p8_entropy
QUERIES["p8_tempered"] = p8_tempered
QUERIES["p8_shares"] = p8_shares


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture(_table(spark, sf_dir, "crawl_pages"), "page_id", site("origin"), "blocks", "content_html")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of each page are left as its body."""
    return main_blocks(_table(spark, sf_dir, "crawl_pages"), "page_id", site("origin"), "blocks", "content_html").select("page_id", F.size("blocks").alias("blocks")).distinct()


QUERIES["p6_found"] = p6_found
QUERIES["p6_clean"] = p6_clean


def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(_table(spark, sf_dir, "crawl_pages"), "page_id", site("origin"), "blocks", "status_code", "failure_reason")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_reasons(spark, sf_dir).select("page_id")


QUERIES["p4_found"] = p4_found
QUERIES["p4_reasons"] = p4_reasons
