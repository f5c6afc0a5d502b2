"""Queries of the llm operators with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.functions.spelling import member_set, prefixed_hex
from statelog.llm import abuse, cooccurrence, distinct, frequent, leaks, setjoin
from statelog.llm.baskets import distinct_baskets, transactions
from statelog.llm.tokenize import encode_texts
from statelog.operators.access import access_sets
from statelog.operators.activity import distinct_blocks
from statelog.plans.dependency import _acc
from statelog.runtime import cut, table

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("STATELOG_TOKENIZERS", "/opt/tokenizers")
#: How byte_bpe_50k parts a text into pieces: the published pattern of its vocabulary.
BYTE_BPE_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
JACCARD, MIN_SET = 0.6, 6
MIN_PAIR, MIN_LIFT = 10, 10
SHARE = 0.01


def _records(spark: SparkSession, d: str) -> DataFrame:
    """``(field, name, members)`` of the transactions and tasks. Copies of a transaction have the same sets."""
    txs, tasks = table(spark, d, "txs"), table(spark, d, "access_sets")
    name = prefixed_hex(F.col("txid"))
    lists = txs.select(name.alias("name"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), member_set(F.col(f)).alias("members")) for f in ("rnw_addr_list", "rdo_addr_list")])).alias("s")).select("name", "s.*")
    sets = tasks.select(name.alias("name"), F.lit("rnw_set").alias("field"), F.transform(F.coalesce(F.col("rnw_set"), F.array().cast("array<binary>")), lambda x: F.hex(x)).alias("members"))
    large = lists.unionByName(sets).where(F.size(F.array_distinct("members")) >= MIN_SET)
    named = F.struct("field", "name")
    return distinct_baskets(large, named, {"members": F.array_sort(F.array_distinct("members"))}).select("name.field", "name.name", "members")


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    members = cut(setjoin.classes(_records(spark, d), MIN_SET))
    return members, setjoin.similar_classes(members, JACCARD)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.record_pairs(*_similar(spark, d)).select("field", F.col("name_a").alias("txid_a"), F.col("name_b").alias("txid_b"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.class_links(*_similar(spark, d)).select("field", F.col("name").alias("txid"), "class_id", "copies", "links")


def p1_between(spark: SparkSession, d: str) -> DataFrame:
    """What tasks declare to write against what transactions write: pairs of different sets of the two tables that largely agree."""
    declared = _records(spark, d).where("field = 'rnw_set'")
    written = access_sets(table(spark, d, "txs"), table(spark, d, "blocks")).select(F.lit("rnw_set").alias("field"), F.concat_ws(" ", "height", "tx_idx", "txid").alias("name"), F.transform("w", F.hex).alias("members"))
    first, second = (cut(setjoin.classes(r, MIN_SET)) for r in (declared, written))
    return setjoin.similar_between(first, second, JACCARD).select("class_a", "class_b", "common", "size_a", "size_b")


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """``(day, coinbase, measure, item)`` of every sender and every rnw address; a height without block row has neither day nor coinbase."""
    t = table(spark, d, "txs")
    sender = F.filter(F.array(prefixed_hex(F.col("from_addr"))), lambda x: x.isNotNull())
    both = F.array(F.struct(F.lit("from_addr").alias("measure"), sender.alias("items")), F.struct(F.lit("rnw_addr_list").alias("measure"), member_set(F.col("rnw_addr_list")).alias("items")))
    blocks = distinct_blocks(table(spark, d, "blocks")).select("height", F.to_date("block_time").alias("day"), "coinbase")
    lists = t.select("height", F.explode(both).alias("m")).select("height", "m.*")
    return lists.join(blocks, "height", "left").select("day", "coinbase", "measure", F.explode("items").alias("item"))


def p2_distinct(spark: SparkSession, d: str) -> DataFrame:
    fine = distinct.sketch_words(_measures(spark, d), ["day", "coinbase", "measure"], "item")
    words = distinct.grouping_words(fine, ["day", "coinbase"], ["measure"])
    return distinct.estimates(words, ["grouping", "day", "coinbase", "measure"])


def p2_bound_check(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts beside the sketches': whether each lies in the stated range."""
    items = _measures(spark, d).distinct()
    sets = [["day", "coinbase"], ["day"], ["coinbase"], []]
    kinds = {"day": "date", "coinbase": "string"}
    one = lambda s: F.struct(F.lit(",".join(s) or "all").alias("grouping"), *[(F.col(c) if c in s else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()])
    exact = items.select(F.explode(F.array(*[one(s) for s in sets])).alias("g"), "measure", "item").select("g.*", "measure", "item").distinct().groupBy("grouping", "day", "coinbase", "measure").agg(F.count("*").alias("n"))
    by = lambda df: df.withColumn("k", F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("grouping", "day", "coinbase", "measure")]))
    est = by(p2_distinct(spark, d)).select("k", "low", "high")
    return by(exact).join(est, "k").select("grouping", "day", "coinbase", "measure", "n", F.col("n").between(F.col("low"), F.col("high")).alias("in_range"))


_P3 = ["rdo_addr_list", "rnw_addr_list", "rnw_slot_list"]


def _pairs(spark: SparkSession, d: str, lift: float, least: int = MIN_PAIR) -> DataFrame:
    return cooccurrence.item_pairs(transactions(table(spark, d, "txs"), _P3), _P3, least, lift)


def _pair_columns(pairs: DataFrame) -> DataFrame:
    return pairs.select("field", "item_a", "item_b", "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, MIN_LIFT).select("field", "item_a", "item_b")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that enough transactions hold, however it compares with chance."""
    return _pair_columns(_pairs(spark, d, 0.0))


def p3_all(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that any transaction holds."""
    return _pair_columns(_pairs(spark, d, 0.0, 1))


_P6 = ["rdo_addr_list", "rnw_addr_list", "slot_addr"]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    hits = frequent.items_with_share(transactions(table(spark, d, "txs"), _P6), _P6, SHARE)
    return hits.select("field", F.col("item").alias("addr"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """The frequent addresses with the sketch's bounds and the exact count; ``in_range`` says whether they agree."""
    hits = frequent.items_with_share(transactions(table(spark, d, "txs"), _P6), _P6, SHARE)
    return hits.select("field", F.col("item").alias("addr"), "n", F.col("n").between(F.col("low"), F.col("high")).alias("in_range"))


def p6_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The frequent addresses with what the sketch says of them: bounds and estimate of the count, beside the exact one."""
    hits = frequent.items_with_share(transactions(table(spark, d, "txs"), _P6), _P6, SHARE)
    return hits.select("field", F.col("item").alias("addr"), "low", "high", "estimate", "n")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", BYTE_BPE_PIECES)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_without(spark: SparkSession, d: str) -> DataFrame:
    """The documents that show no test item."""
    docs = table(spark, d, "documents")
    return leaks.without_leaks(docs, leaks.find_leaks(docs, table(spark, d, "eval_items"))).select("doc_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with leaked stretches taken out."""
    return leaks.remove_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_clean_check(spark: SparkSession, d: str) -> DataFrame:
    """Test items that a cleaned document still shows: none."""
    return leaks.find_leaks(p9_clean(spark, d), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = abuse.fit(abuse.labelled_texts(docs, table(spark, d, "doc_labels")))
    return abuse.score_texts(docs, model, ("doc_id", "source"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "source", "score")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, flagged documents and their rate per source; documents without source form a group of their own."""
    flagged = F.sum((F.col("score") >= abuse.THRESHOLD).cast("long"))
    return _scored(spark, d).groupBy("source").agg(F.count("*").alias("n_docs"), flagged.alias("n_flagged"), F.round(flagged / F.count("*"), 6).alias("rate"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_between, p2_distinct, p2_bound_check, p3_found, p3_pairs, p3_all, p6_found, p6_counts, p6_bounds, p8_ids, p9_found, p9_without, p9_clean, p9_clean_check, p10_found, p10_scores, p10_rates)}


def _hex(e: str) -> str:
    s = f"regexp_replace(lower(trim({e}, e' \\t\\n\\r\\f\\v')), '^0x', '')"
    return f"'0x' || nullif({s}, '')"


_ITEMS = f"""
t as (select {_hex("txid")} as tx, rdo_addr_list, rnw_addr_list, rdo_slot_list, rnw_slot_list from txs where {_hex("txid")} is not null),
raw as (
  select 'rdo_addr_list' as field, tx, {_hex("a")} as item from (select tx, unnest(rdo_addr_list) as a from t)
  union all select 'rnw_addr_list', tx, {_hex("a")} from (select tx, unnest(rnw_addr_list) as a from t)
  union all select 'rnw_slot_list', tx, {_hex("s.addr")} || ':' || s."index" from (select tx, unnest(rnw_slot_list) as s from t)
  union all select 'slot_addr', tx, {_hex("s.addr")} from (select tx, unnest(rdo_slot_list) as s from t union all select tx, unnest(rnw_slot_list) from t)),
item as (select distinct field, tx, item from raw where item is not null),
n as (select field, item, count(*) as n from item group by field, item),
total as (select count(distinct tx) as total from t)"""

_PAIRS = f"""with {_ITEMS},
f as (select i.field, i.tx, i.item, n.n from item i join n on n.field = i.field and n.item = i.item where n.n >= 10 and i.field <> 'slot_addr'),
p as (
  select a.field, a.item as item_a, b.item as item_b, a.n as n_a, b.n as n_b, count(*) as n_ab
  from f a join f b on a.field = b.field and a.tx = b.tx and a.item < b.item group by all having count(*) >= 10)"""

_ALL_PAIRS = _PAIRS.replace("n.n >= 10 and ", "").replace(" having count(*) >= 10", "")

SQL = {
    "p1_found": f"""with {_ITEMS},
r as (
  select field, tx, item from item where field in ('rdo_addr_list', 'rnw_addr_list')
  union select 'rnw_set', {_hex("txid")}, hex(m) from (select txid, unnest(rnw_set) as m from access_sets) where m is not null),
s as (select field, tx, item, count(*) over (partition by field, tx) as size from r),
big as (select * from s where size >= 6),
c as (select a.field, a.tx as txid_a, b.tx as txid_b, a.size + b.size as sizes, count(*) as common from big a join big b on a.field = b.field and a.item = b.item and a.tx < b.tx group by all)
select field, txid_a, txid_b from c where common * 10 >= 6 * (sizes - common)""",
    "p1_classes": f"""with {_ITEMS},
r as (
  select field, tx, item from item where field in ('rdo_addr_list', 'rnw_addr_list')
  union select 'rnw_set', {_hex("txid")}, hex(m) from (select txid, unnest(rnw_set) as m from access_sets) where m is not null),
g as (select field, tx, list_sort(list(item)) as s from r group by field, tx having count(*) >= 6),
cls as (select field, tx, s, sha256(to_json(s)::varchar) as class_id from g),
u as (select field, class_id, unnest(s) as item, len(s) as size from (select distinct field, class_id, s from cls)),
j as (select a.field, a.class_id, b.class_id as other, a.size + b.size as sizes, count(*) as common from u a join u b on a.field = b.field and a.item = b.item and a.class_id <> b.class_id group by all),
l as (select field, class_id, count(*) as links from j where common * 10 >= 6 * (sizes - common) group by all)
select cls.field, cls.tx as txid, cls.class_id, count(*) over (partition by cls.field, cls.class_id) as copies, coalesce(l.links, 0) as links
from cls left join l on l.field = cls.field and l.class_id = cls.class_id""",
    "p1_between": f"""with {_acc()},
r as (
  select distinct 'd' as side, {_hex("txid")} as name, hex(m) as item from (select txid, unnest(rnw_set) as m from access_sets) where m is not null and {_hex("txid")} is not null
  union all select 'w', height || ' ' || tx_idx || ' ' || tx, upper(hash) from acc where mode = 'w'),
g as (select side, name, list_sort(list(item)) as s from r group by side, name having count(*) >= 6),
c as (select distinct side, sha256(to_json(s)::varchar) as class_id, s from g),
u as (select side, class_id, unnest(s) as item, len(s) as size from c),
j as (
  select a.class_id as x, b.class_id as y, a.size as sx, b.size as sy, count(*)::integer as common from u a join u b on a.item = b.item and a.class_id <> b.class_id
  where a.side = 'd' and b.side = 'w' group by all)
select distinct least(x, y) as class_a, greatest(x, y) as class_b, common, (case when x < y then sx else sy end)::integer as size_a, (case when x < y then sy else sx end)::integer as size_b
from j where common * 10 >= 6 * (sx + sy - common)""",
    "p9_clean_check": "select 0::bigint as doc_id, 0::bigint as item_id where false",
    "p2_bound_check": f"""with b as (select height, max({_hex("coinbase")}) as coinbase, min(block_time)::date as day from blocks group by height),
i as (
  select day, coinbase, 'from_addr' as measure, {_hex("from_addr")} as item from txs left join b using (height)
  union all
  select day, coinbase, 'rnw_addr_list', {_hex("a")} from (select day, coinbase, unnest(rnw_addr_list) as a from txs left join b using (height)))
select case grouping(day, coinbase) when 0 then 'day,coinbase' when 1 then 'day' when 2 then 'coinbase' else 'all' end as grouping,
  day, coinbase, measure, count(distinct item) as n, true as in_range
from i where item is not null group by grouping sets ((day, coinbase, measure), (day, measure), (coinbase, measure), (measure))""",
    "p3_found": _PAIRS + " select field, item_a, item_b from p, total where n_ab * total >= 10 * n_a * n_b",
    "p3_pairs": _PAIRS + " select field, item_a, item_b, n_a, n_b, n_ab, round(n_ab * total::double / (n_a * n_b::double), 6) as lift, round(log2(n_ab * total::double / (n_a * n_b::double)), 6) as pmi from p, total",
    "p3_all": _ALL_PAIRS + " select field, item_a, item_b, n_a, n_b, n_ab, round(n_ab * total::double / (n_a * n_b::double), 6) as lift, round(log2(n_ab * total::double / (n_a * n_b::double)), 6) as pmi from p, total",
    "p6_found": f"with {_ITEMS} select field, item as addr from n, total where field <> 'rnw_slot_list' and n * 100 >= total",
    "p6_counts": f"with {_ITEMS} select field, item as addr, n, true as in_range from n, total where field <> 'rnw_slot_list' and n * 100 >= total",
}
