"""Texts against named synonyms: clients, captions, page titles, with global one-to-one assignment."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as X
from recordloom.functions.bind import bind
from recordloom.functions.fuzzy import Synonyms, alphabet, char_counts, fuzzy_score, score_bound, solid_length

#: Captions of bill columns.
FIELD_SYNONYMS = {
    "sr_no": ["sr no", "s no", "serial no", "sl no"],
    "bill_no": ["bill no", "bill number"],
    "invoice_no": ["invoice no", "invoice number"],
    "shipment_no": ["shipment no", "shipment number"],
    "lr_no": ["lr no", "lr number", "lorry receipt no"],
    "lr_date": ["lr date", "date"],
    "arrival_date": ["arrival date"],
    "vehicle_no": ["vehicle no", "truck no", "vehicle number"],
    "delivery_station": ["delivery station"],
    "from_destination": ["from destination", "from origin"],
    "to_destination": ["to destination"],
    "gross_qty": ["gross qty", "invoice qty", "quantity"],
    "charge_qty": ["charge qty", "charged qty"],
    "rate": ["rate"],
    "amount": ["amount"],
    "short_qty_charges": ["short qty charges", "short qty"],
    "ld_charges": ["ld charges"],
    "balance_pay": ["balance pay", "balancepay"],
    "delivery_date": ["delivery date"],
    "party_name": ["party name", "consignee"],
    "vehicle_type": ["vehicle type", "truck type"],
    "description": ["description of product", "description"],
}
#: Titles of pages.
TITLE_SYNONYMS = {"tax_invoice": ["transportation tax invoice", "gst tax invoice", "freight invoice", "tax invoice"]}
CAPTION_THRESHOLD, TITLE_THRESHOLD, RECORD_THRESHOLD = 70.0, 70.0, 82.0


def synonym_table(spark: SparkSession, pool: dict[str, list[str]]) -> DataFrame:
    """(field, field_ord, synonym, syn_ord) of a pool; its size is that of the pool."""
    rows = [(f, i, s, j) for i, (f, ss) in enumerate(pool.items()) for j, s in enumerate(ss)]
    return spark.createDataFrame(rows, "field string, field_ord int, synonym string, syn_ord int")


def possible_pairs(text: Column, pool: dict[str, list[str]], threshold: float) -> Column:
    """The synonyms (field, field_ord, synonym) of a pool that may reach the threshold with a text, judged in the JVM by `score_bound`: only these have to be scored."""
    flat = [(f, i, s) for i, (f, ss) in enumerate(pool.items()) for s in ss]
    letters = alphabet([s for _, _, s in flat])
    pair = lambda x, f, i, s: F.when(score_bound(x["size"], x["solid"], x["counts"], s, letters) >= threshold, F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_ord"), F.lit(s).alias("synonym")))
    known = F.struct(char_counts(text, letters).alias("counts"), F.length(text).alias("size"), solid_length(text).alias("solid"))
    return bind(known, lambda x: F.filter(F.array(*[pair(x, f, i, s) for f, i, s in flat]), lambda p: p.isNotNull()))


MATCH = "array<struct<field: string, field_ord: int, score: double>>"


def _fields_of(synonyms: Synonyms, texts: pa.Array) -> pa.Array:
    """The matches of each text, as MATCH; texts alike are scored once."""
    known = texts.dictionary_encode()
    values, codes = known.dictionary.to_pylist(), known.indices.fill_null(len(known.dictionary))
    found = [[{"field": synonyms.fields[k][0], "field_ord": k, "score": s} for k, s in m] for m in synonyms.matches(values)]
    return pa.array([*found, []], pa.list_(pa.struct([("field", pa.string()), ("field_ord", pa.int32()), ("score", pa.float64())]))).take(codes)


def matched(text: Column, pool: dict[str, list[str]], threshold: float, guard: str | None = None) -> Column:
    """A cleaned text's fields (field, field_ord, score) whose best synonym scores enough; none for null."""
    synonyms = Synonyms(pool, threshold, guard)

    def run(texts: pa.Array) -> pa.Array:
        return _fields_of(synonyms, texts)

    return F.arrow_udf(run, MATCH).asNondeterministic()(text)  # so it keeps a projection of its own


def all_matched(texts: Column, pool: dict[str, list[str]], threshold: float, guard: str | None = None) -> Column:
    """`matched` of each text of an array."""
    synonyms = Synonyms(pool, threshold, guard)

    def run(lists: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), _fields_of(synonyms, lists.flatten()))

    return F.arrow_udf(run, f"array<{MATCH}>").asNondeterministic()(texts)


def synonym_matches(texts: DataFrame, pool: dict[str, list[str]], keys: list[str], threshold: float = CAPTION_THRESHOLD, guard: str | None = None) -> DataFrame:
    """(keys, idx, field, field_ord, score) of cleaned texts and fields whose best synonym scores enough.

    texts: keys, idx, text; a row that is given twice counts once. A guard holds for a field if it holds for any of its synonyms.
    """
    t = texts.where(X.strip("text") != "").select(*keys, "idx", "text").distinct()
    return t.select(*keys, "idx", F.explode(matched(F.col("text"), pool, threshold, guard)).alias("m")).select(*keys, "idx", "m.*")


def guarded(text: Column, field: Column, pool: dict[str, list[str]], guard: str) -> Column:
    """Whether a text starts with a synonym of the field or is half to three times as long as one."""
    junk = r"\s+" if guard == "solid" else r"[^\p{L}\p{N}]"
    n = F.length(F.regexp_replace(text, junk, ""))
    size = lambda s: len("".join(s.split())) if guard == "solid" else sum(c.isalnum() for c in s)
    one = lambda s: text.startswith(s) | n.between(size(s) * 0.5, size(s) * 3)
    tests = [(field == f) & reduce(lambda a, b: a | b, [one(s) for s in ss]) for f, ss in pool.items()]
    return reduce(lambda a, b: a | b, tests)


ENTRY = "struct<back: double, idx: int, field_ord: int, field: string>"


def _taken(found: Column) -> Column:
    """A10 on an array of ENTRY: by falling score those whose text and field are both free."""

    def take(taken, x):
        busy = F.exists(taken, lambda t: (t["idx"] == x["idx"]) | (t["field_ord"] == x["field_ord"]))
        return F.when(busy, taken).otherwise(F.concat(taken, F.array(x.cast(ENTRY))))

    return F.aggregate(F.array_sort(found), F.array().cast(f"array<{ENTRY}>"), take)


def greedy_assign(matches: DataFrame, keys: list[str]) -> DataFrame:
    """A10: (keys, idx, field, score): matches by falling score, each taken if its text and field are both free.

    Ties go to the smaller idx, then to the field that the pool names first. A group holds the matches of one table or page.
    """
    found = F.collect_list(F.struct((-F.col("score")).alias("back"), F.col("idx").cast("int").alias("idx"), "field_ord", "field"))
    g = matches.groupBy(*keys).agg(found.alias("found")).select(*keys, F.explode(_taken(F.col("found"))).alias("t"))
    return g.select(*keys, "t.idx", "t.field", (-F.col("t.back")).alias("score"))


def grouped_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group brought together by one shuffle before anything is made of them: groups are few bytes for what they cost, so partitions are not merged by bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def assigned_values(pairs: DataFrame, keys: list[str], pool: dict[str, list[str]], text: Column, threshold: float, guard: str | None = None, own: Column | None = None, cleaners: dict | None = None) -> DataFrame:
    """(keys and the fields of the pool): of each group's pairs (keys, idx, value) the value, cleaned, of the text that is assigned to a field; null if none is.

    own: the fields that a row may have, an array, if it is not all. Every group has a row. One shuffle brings a group together, its texts are scored there, and no row moves again.
    """
    rows = F.struct(F.col("idx").cast("int").alias("idx"), F.col("value"), F.when(X.strip(text) != "", text).alias("text"), *([] if own is None else [own.alias("own")]))
    g = grouped_by(pairs, keys).groupBy(*keys).agg(F.collect_list(rows).alias("_all"))
    g = g.withColumn("_m", all_matched(F.col("_all.text"), pool, threshold, guard))
    mine = lambda x, ms: ms if own is None else F.filter(ms, lambda m: F.array_contains(x["own"], m["field"]))
    entry = lambda x, ms: F.transform(mine(x, ms), lambda m: F.struct((-m["score"]).alias("back"), x["idx"].alias("idx"), m["field_ord"].alias("field_ord"), m["field"].alias("field")))
    taken = _taken(F.flatten(F.zip_with("_all", "_m", entry)))
    values = lambda t: F.transform(F.filter("_all", lambda x: x["idx"] == t["idx"]), lambda x: x["value"])
    named = F.map_from_entries(F.transform(taken, lambda t: F.struct(t["field"].alias("field"), values(t).alias("values"))))
    clean = {n: (cleaners or {}).get(n, lambda x: x) for n in pool}
    return g.select(*keys, named.alias("_named")).select(*keys, *[F.array_max(F.transform(F.col("_named")[n], clean[n])).alias(n) for n in pool])


def match_captions(captions: DataFrame, pool: dict[str, list[str]] | None = None) -> DataFrame:
    """(table_id, col_idx, field, score) of captions (table_id, col_idx, caption)."""
    texts = captions.select("table_id", F.col("col_idx").alias("idx"), X.caption_words("caption").alias("text"))
    found = greedy_assign(synonym_matches(texts, pool or FIELD_SYNONYMS, ["table_id"]), ["table_id"])
    return found.withColumnRenamed("idx", "col_idx")


def title_pages(bands: DataFrame, page_type: str = "tax_invoice", threshold: float = TITLE_THRESHOLD, region: float = 0.2) -> DataFrame:
    """(doc_id, page_no) of pages with a title band that scores enough and is at most three times as long as the synonym.

    bands: doc_id, page_no, top (share of the page's height), text. Long bands, and those that cannot reach the threshold, are out before anything is scored.
    """
    b = bands.where(F.col("top") <= region).withColumn("text", F.lower(X.strip("text"))).where("text <> ''")
    pairs = b.select("doc_id", "page_no", "text", F.explode(possible_pairs(F.col("text"), {page_type: TITLE_SYNONYMS[page_type]}, threshold)).alias("s")).where(F.length("text") <= 3 * F.length("s.synonym"))
    return pairs.where(fuzzy_score(F.col("text"), F.col("s.synonym")) >= threshold).select("doc_id", "page_no").distinct()


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def detect_client(texts: DataFrame, clients: list[str] | DataFrame, name: str = "text", gram: int = 3) -> DataFrame:
    """Texts with client: the first of the configured ids that a text contains, both squeezed to letters and digits; empty if none is.

    clients: ids in order, or a table (client, ord). A text that contains an id contains its first `gram` letters, so texts meet ids in a join on these, and only
    those pairs are tested; ids shorter than that meet the shorter stretches. Texts alike meet once. Neither the plan nor the rows grow with clients times texts.
    """
    spark = texts.sparkSession
    table = clients if isinstance(clients, DataFrame) else spark.createDataFrame([(c, i) for i, c in enumerate(clients)], "client string, ord int")
    ids = table.select("client", "ord", squeezed(F.col("client")).alias("_id")).where("_id <> ''").groupBy("_id").agg(F.min_by("client", "ord").alias("_client"), F.min("ord").alias("_ord"))
    ids = ids.withColumn("_gram", F.left("_id", F.lit(gram)))
    known = texts.withColumn("_text", squeezed(F.col(name)))
    stretches = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_text"), F.lit(1))), lambda i: F.substr("_text", i, F.lit(k)))
    grams = F.filter(F.array_distinct(F.flatten(F.array(*[stretches(k) for k in range(1, gram + 1)]))), lambda g: g != "")
    hit = known.select("_text").where("_text <> ''").distinct().select("_text", F.explode(grams).alias("_gram")).join(ids, "_gram").where(F.contains("_text", "_id"))
    first = hit.groupBy("_text").agg(F.min_by("_client", "_ord").alias("client"))
    return known.drop(*(["client"] if "client" in texts.columns else [])).join(first, "_text", "left").withColumn("client", F.coalesce("client", F.lit(""))).select(*[c for c in texts.columns if c != "client"], "client")


def locate_anchor(phrases: DataFrame, synonyms: list[str], keys: list[str], threshold: float = RECORD_THRESHOLD) -> DataFrame:
    """Per page the phrase that scores best and passes the guard of letters and digits; on ties one that starts with a synonym, then the shortest, then the first."""
    pool = {"anchor": synonyms}
    pairs = phrases.withColumn("low", F.lower(X.strip("text"))).where("low <> ''").where(guarded(F.col("low"), F.lit("anchor"), pool, "alnum"))
    pairs = pairs.select("*", F.explode(possible_pairs(F.col("low"), pool, threshold)).alias("s")).withColumn("synonym", F.col("s.synonym"))
    starts = reduce(lambda a, b: a | b, [F.col("low").startswith(s) for s in synonyms])
    scored = pairs.withColumn("score", fuzzy_score("low", "synonym")).groupBy(*keys, "idx", "text", "low").agg(F.max("score").alias("score"))
    order = F.struct(-F.col("score"), (~starts).cast("int"), F.length("low"), F.col("idx"))
    best = F.min_by(F.struct("idx", "text", "score"), order)
    return scored.where(F.col("score") >= threshold).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def with_anchors(pages: DataFrame, found: str, anchors: dict[str, list[str]], threshold: float = RECORD_THRESHOLD, guard: str | None = "alnum") -> DataFrame:
    """J22 in place: pages with a column `anchor_<name>` for each anchor: the phrase (of the array column `found`) that `locate_anchor` would choose, or null.
    Without a guard the first of those that score best is taken, whatever it starts with.

    The phrases of a batch of pages are scored together, texts alike once; no row moves.
    """
    synonyms, names = Synonyms(anchors, threshold, guard), list(anchors)

    def rank(low: str, field: int, score: float) -> tuple:
        return (-score, not low.startswith(tuple(anchors[names[field]])), len(low)) if guard else (-score,)

    def run(lists: pa.Array) -> pa.Array:
        known = lists.flatten().dictionary_encode()
        texts = [*known.dictionary.to_pylist(), ""]  # the last stands for null
        ranked = [[(k, rank(t, k, s)) for k, s in m] for t, m in zip(texts, synonyms.matches(texts), strict=True)]
        codes, row = known.indices.fill_null(len(texts) - 1).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        some, first = np.array([bool(m) for m in ranked], bool), np.searchsorted(row, np.arange(len(lists)))
        best: list[list] = [[None] * len(names) for _ in range(len(lists))]
        for at in (np.flatnonzero(some[codes]) if len(codes) else []):
            here, i = best[row[at]], int(at - first[row[at]])
            for k, r in ranked[codes[at]]:
                if here[k] is None or (r, i) < here[k]:
                    here[k] = (r, i)
        return pa.array([[b if b is None else b[1] for b in here] for here in best], pa.list_(pa.int32()))

    p = pages.withColumn("_low", F.transform(found, lambda p: F.lower(X.strip(p["text"])))).withColumn("_best", F.arrow_udf(run, "array<int>").asNondeterministic()("_low"))
    return p.withColumns({f"anchor_{n}": F.get(F.col(found), F.get("_best", F.lit(k))) for k, n in enumerate(names)}).drop("_low", "_best")
