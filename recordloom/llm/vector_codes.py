"""Codes for vectors: each part of a vector is named by the nearest entry of a codebook that Lloyd's rounds have made.

Everything is in whole numbers, so sums do not depend on their order and reruns agree. Between rounds each part keeps two
bounds, as Hamerly does: an upper one of the distance to its own entry and a lower one of that to any other. When entries move, the
upper bound grows by what the own entry moved and the lower one shrinks by the most that any entry moved. As long as the upper one is strictly
less, no other entry is as near, not even as a tie, and the part stays where it is. If not, the distance to the own entry is taken
anew, and only if the bounds still meet are all entries compared. Bounds are rounded outwards, so that no error of floating point can keep a wrong entry.

A round is two jobs over the table of parts in the shared folder: one moves the parts and writes them with their bounds, one sums them by
entry. Tasks pre-aggregate, so what meets in the shuffle, and reaches the driver, is a row for each entry, whatever the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recordloom.llm.common import bounded_batches, checkpointed
from recordloom.llm.simhash import with_owner

#: Whole numbers beyond this count as this: squared distances of 1,024 components then stay within 64 bits.
MOST = (1 << 25) - 1
#: Outward rounding of a bound, as a share of it and by itself.
SLACK, LEAST = 1e-12, 1e-9


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, ints): vectors without null or non-finite components, as floor(scale * x)."""
    x = lambda v: v.cast("double")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    whole = F.transform("embedding", lambda v: F.greatest(F.least(F.floor(F.least(F.greatest(x(v) * scale, F.lit(-1e15)), F.lit(1e15))), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return vectors.where(F.col("embedding").isNotNull() & ~bad).select("vec_id", "label", whole.alias("ints"))


def padded(rows: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """All vectors filled up with zeros to the longest one's length, rounded up to a multiple of `parts`; and that length."""
    longest = rows.agg(F.max(F.size("ints"))).first()[0] or 0
    size = -(-longest // parts) * parts
    return rows.withColumn("ints", F.slice(F.concat("ints", F.array_repeat(F.lit(0), F.lit(size) - F.size("ints"))), 1, max(size, 1))), size


def first_entries(rows: DataFrame, entries: int, parts: int, size: int) -> np.ndarray:
    """(parts, entries, size / parts): the parts of the vectors with the smallest ids, null ids last, equal ids by their components."""
    head = rows.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()
    return np.array([r[0] for r in head], np.int64).reshape(len(head), parts, size // parts).transpose(1, 0, 2).copy()


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(rows, entries): exact squared distances of the rows of one part."""
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(book.shape[1]):
        gap = x[:, k, None] - book[None, :, k]
        out += gap * gap
    return out


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower of equals), the bound from above of its distance, and that from below of the second nearest."""
    d = distances(x, book)
    code, rows = d.argmin(axis=1), np.arange(len(x))
    upper = np.sqrt(d[rows, code].astype(float)) * (1 + SLACK) + LEAST
    if len(book) == 1:
        return code, upper, np.full(len(x), np.inf)
    d[rows, code] = np.iinfo(np.int64).max
    return code, upper, np.sqrt(d.min(axis=1).astype(float)) * (1 - SLACK) - LEAST


def own(x: np.ndarray, book: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Exact squared distances to the entries named."""
    gap = x - book[code]
    return (gap * gap).sum(axis=1)


def moved(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds of one part after its entries went from `old` to `new`, and how many rows were compared with all of them."""
    gap = new - old
    shift = np.sqrt((gap * gap).sum(axis=1).astype(float)) * (1 + SLACK) + LEAST * (gap != 0).any(axis=1)
    order = np.argsort(-shift, kind="stable")
    most = np.full(len(new), shift[order[0]])
    most[order[0]] = shift[order[1]] if len(new) > 1 else 0.0  # what others moved at most
    upper, lower, code = upper + shift[code], lower - most[code], code.copy()
    open_ = np.flatnonzero(~(upper < lower))
    upper[open_] = np.sqrt(own(x[open_], new, code[open_]).astype(float)) * (1 + SLACK) + LEAST
    open_ = open_[~(upper[open_] < lower[open_])]
    if len(open_):
        code[open_], upper[open_], lower[open_] = scan(x[open_], new)
    return code, upper, lower, len(open_)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1), kind))


def assigned(rows: DataFrame, book: np.ndarray, old: np.ndarray | None = None) -> DataFrame:
    """rows with the columns code, upper and lower, an element a part: by comparison with all entries, or, if `old` is given, by the bounds they have."""
    parts, _, width = book.shape
    base = [f for f in rows.schema.fields if f.name in ("vec_id", "label", "ints")]
    more = [T.StructField("code", T.ArrayType(T.IntegerType())), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("upper", "lower")]]
    kind = T.StructType(base + more)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("ints"), np.int64).reshape(b.num_rows, parts, width)
            code, upper, lower = np.empty((b.num_rows, parts), np.int64), np.empty((b.num_rows, parts)), np.empty((b.num_rows, parts))
            before = None if old is None else (_matrix(b.column("code"), np.int64), _matrix(b.column("upper"), float), _matrix(b.column("lower"), float))
            for p in range(parts):
                if before is None:
                    code[:, p], upper[:, p], lower[:, p] = scan(x[:, p], book[p])
                else:
                    code[:, p], upper[:, p], lower[:, p], _ = moved(x[:, p], *[c[:, p] for c in before], old[p], book[p])
            columns = [b.column(f.name) for f in base] + [_lists(code.astype(np.int32), pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return checkpointed(rows.mapInArrow(run, kind))


def entry_sums(rows: DataFrame, book: np.ndarray) -> DataFrame:
    """(part, entry, n, sums): the parts of each entry, counted and summed; each task sums its own first."""
    parts, entries, width = book.shape
    kind = "part int, entry int, n long, sums array<long>"

    def run(batches):
        sums, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            at = (_matrix(b.column("code"), np.int64) + np.arange(parts) * entries).reshape(-1)
            n += np.bincount(at, minlength=len(n))
            np.add.at(sums, at, _matrix(b.column("ints"), np.int64).reshape(-1, width))
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)), pa.array(n[used]), _lists(sums[used], pa.int64())], ["part", "entry", "n", "sums"])

    partial = rows.select("ints", "code").mapInArrow(run, kind)
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums"))


def replaced(book: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The entries as floor(sum / count) of their parts; those without parts stay. A row for each entry reaches the driver."""
    new = book.copy()
    for r in sums.collect():
        new[r.part, r.entry] = np.array([s // r.n for s in r.sums], np.int64)
    return new


def codebooks(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """The table (vec_id, label, ints, code, upper, lower) of all vectors that are kept, and the codebooks (parts, entries, width).

    Entries start as the parts of the vectors with the smallest ids. In each round parts go to the nearest entry and entries to their
    parts' mean, rounded down; at last parts are assigned again. With fewer vectors than entries there are as many entries as vectors.
    """
    bounded_batches(vectors.sparkSession)
    rows, size = padded(checkpointed(scaled(vectors, scale)), parts)
    book = first_entries(rows, entries, parts, size)
    if not book.size:
        empty = rows.withColumns({"code": F.array_repeat(F.lit(0), parts), "upper": F.array(F.lit(0.0)), "lower": F.array(F.lit(0.0))})
        return empty, book
    state = assigned(rows, book)
    for _ in range(rounds):
        new = replaced(book, entry_sums(state, book))
        state, book = assigned(state, new, book), new
    return state, book


def errors(state: DataFrame, book: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): code as array, error the squared distances of all parts to their entries."""
    parts, _, width = book.shape
    kind = T.StructType([state.schema["vec_id"], state.schema["label"], state.schema["code"], T.StructField("error", T.LongType())])
    arrow = to_arrow_schema(kind)

    def run(batches):
        for b in batches:
            x, code, total = _matrix(b.column("ints"), np.int64).reshape(b.num_rows, parts, width), _matrix(b.column("code"), np.int64), np.zeros(b.num_rows, np.int64)
            for p in range(parts):
                total += own(x[:, p], book[p], code[:, p])
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([b.column("vec_id"), b.column("label"), b.column("code"), pa.array(total)], arrow, strict=True)], schema=arrow)

    return state.select("vec_id", "label", "ints", "code").mapInArrow(run, kind) if book.size else state.select("vec_id", "label", "code", F.lit(0).cast("long").alias("error"))


def reconstructed(state: DataFrame, book: np.ndarray, scale: int = 256) -> DataFrame:
    """(vec_id, approx): the vectors that the codes stand for; the codebooks go along as a literal of bounded size."""
    if not book.size:
        return state.select("vec_id", F.array().cast("array<double>").alias("approx"))
    entry = F.array(*[F.array(*[F.array(*[F.lit(float(v) / scale) for v in e]) for e in part]) for part in book])
    return state.select("vec_id", F.flatten(F.transform("code", lambda c, p: F.get(F.get(entry, p), c))).alias("approx"))


def digest(book: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def hex_code(code: Column) -> Column:
    return F.lower(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector (vec_id, embedding, label) that is kept.

    Vectors that are null or have null, NaN or infinite components go. Ties go to the lower entry, between parts and vectors
    alike. Rows that repeat count each time and stay. Null ids come last among the first entries; null labels are one label. Shorter vectors,
    and lengths that are no multiple of `parts`, are filled up with zeros; whole numbers beyond 2^25 count as 2^25 - 1. At most 256 entries
    have two hex digits. No rows, or none that is kept, give an empty table. Other columns are not read. A label, however common, is summed in
    tasks first and given back by `with_owner`.
    """
    if entries > 256:
        raise ValueError("codes have two hex digits: at most 256 entries")
    state, book = codebooks(vectors, parts, entries, rounds, scale)
    found = checkpointed(errors(state, book).select("vec_id", hex_code(F.col("code")).alias("code"), "error", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0).cast(state.schema["label"].dataType)).alias("label")).alias("key")))
    sums = checkpointed(found.groupBy("key").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")))
    total = sums.agg(F.sum("n")).first()[0] or 0  # one number
    return with_owner(found, sums, "key", total).select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))
