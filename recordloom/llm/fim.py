"""Fill-in-middle: a text is cut into prefix, middle and suffix between units, and the parts are put in another order.

Units follow a grammar: pairs of neighbouring character classes between which one unit ends and the next begins. Each
grammar becomes a regular expression of zero width, a lookbehind for the first class and a lookahead for the second,
and Spark's `split` at it loses nothing: the pieces joined are the text. An empty text would split into one empty piece,
so it is told apart and has no units.

A long text is never an array of all its units: it is first cut into blocks of whole units, then one block after the other
is split to be counted, and once more only where a cut falls inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import with_text

ANY = r"\s\S"
#: Pairs of classes (what ends a unit, what begins the next), as the inside of brackets.
GRAMMARS: dict[str, tuple[tuple[str, str], ...]] = {
    "code points": ((ANY, ANY),),
    "words": ((r"\s", r"\S"),),
    "lines": ((r"\n", ANY),),
    "sentences": ((r".!?", r"\s"),),
    "digits and the rest": ((r"\p{Nd}", r"\P{Nd}"), (r"\P{Nd}", r"\p{Nd}")),
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that a block has at least, but for a text's last.
BLOCK = 1 << 14


def boundary(grammar: str) -> str:
    """The zero-width regular expression of a grammar's boundaries."""
    one = lambda c: "(?s:.)" if c == ANY else f"[{c}]"
    return "|".join(f"(?<={one(before)})(?={one(after)})" for before, after in GRAMMARS[grammar])


def units(text: Column, grammar: str) -> Column:
    """The units of a text in order; they join to the text, and an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar)))


def blocks(text: Column, grammar: str, block: int = BLOCK) -> Column:
    """Stretches of whole units, of at least `block` code points but for the last; they join to the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{block}}}.*?(?:{boundary(grammar)}|\z)"), F.lit(0))


def _code_points(k: Column, grammar: str) -> Column:
    """The code points of the first k units, from the columns `blocks` and `counts`."""

    def step(state, x):
        take = F.greatest(F.lit(0), F.least(k - state["units"], x["counts"].cast("long")))
        rest = F.element_at(F.split(x["blocks"], boundary(grammar), (take + 1).cast("int")), -1)  # what is left once `take` units are split off
        chars = F.when(take == 0, 0).when(take == x["counts"], F.length(x["blocks"])).otherwise(F.length(x["blocks"]) - F.length(rest))
        return F.struct((state["units"] + x["counts"]).alias("units"), (state["chars"] + chars).alias("chars"))

    return F.aggregate(F.arrays_zip("blocks", "counts"), F.struct(F.lit(0).cast("long").alias("units"), F.lit(0).cast("long").alias("chars")), step)["chars"]


def draws(seed: int, n: int = 4) -> list[Column]:
    """The first n groups of eight hex digits of sha256("<seed>:<doc_id>") as unsigned integers; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def fill_in_middle(docs: DataFrame, grammar: str = "code points", seed: int = 1, plain_from: int = 90, spm_below: int = 20, block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, and the columns `keep`) of every document.

    n: units of the text. The first two draws, each modulo n + 1, are where the middle begins and ends, in units. form: plain if the
    text is empty or has one of the three marks in it, or by the third draw, from `plain_from` of a hundred on; else spm (suffix
    first) by the fourth draw, below `spm_below` of a hundred, or psm. prefix_chars and middle_chars count code points and are null for plain.
    Null text is empty. A null id draws from the seed alone. Rows with the same id draw alike, and repeated rows stay, each with its
    result. A null id or text never goes. An empty table gives no rows. Columns not named are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("_text"), *[F.col(c).alias(c) for c in keep], F.array(*draws(seed)).alias("_h")).withColumn("blocks", blocks(F.col("_text"), grammar, block))
    d = d.withColumn("counts", F.transform("blocks", lambda b: F.size(units(b, grammar))))
    d = d.withColumn("n", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("_text").contains(m)
    form = F.when((F.col("_text") == "") | marked | (F.get("_h", F.lit(2)) % 100 >= plain_from), "plain").when(F.get("_h", F.lit(3)) % 100 < spm_below, "spm").otherwise("psm")
    cut = [F.get("_h", F.lit(k)) % (F.col("n") + 1) for k in (0, 1)]
    d = d.withColumns({"form": form, "_lo": F.least(*cut), "_hi": F.greatest(*cut)})
    cuts = F.when(F.col("form") != "plain", F.struct(_code_points(F.col("_lo"), grammar).alias("lo"), _code_points(F.col("_hi"), grammar).alias("hi")))
    d = d.withColumn("_cuts", cuts).withColumns({"prefix_chars": F.col("_cuts.lo"), "middle_chars": F.col("_cuts.hi") - F.col("_cuts.lo")})
    at = lambda begin, size: F.substr("_text", (begin + 1).cast("int"), size.cast("int"))
    prefix, middle = at(F.lit(0), F.col("prefix_chars")), at(F.col("prefix_chars"), F.col("middle_chars"))
    suffix = at(F.col("_cuts.hi"), F.length("_text"))
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("_text"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"), *keep)


def restored(output: Column, form: Column) -> Column:
    """The text that a form was made of: the output is split at the marks, which the text has none of, and its parts are put back."""
    part = lambda k: F.get(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}"), F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def transformed(docs: DataFrame, grammar: str = "code points", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """The documents, all their columns, with the output in the place of the text; n_chars, if there, is counted anew."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    out = fill_in_middle(packed, grammar, seed, plain_from, spm_below, keep=("row",))
    return with_text(out, docs, F.col("output"))


def digests(docs: DataFrame, **options) -> DataFrame:
    """`fill_in_middle` with sha256 of its output and of the text rebuilt from it, in the place of the output."""
    out = fill_in_middle(docs, **options)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
