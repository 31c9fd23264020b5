"""Vector codes: product codebooks fitted by rounds of exact assignment, and codes by equal-average search.

Components become whole numbers, floor(SCALE x). A vector is cut into PARTS consecutive parts, each with a codebook of
its own. A round assigns every part to its nearest entry and replaces each entry by the floor of its parts' mean; after
the last round parts are assigned again, which gives the codes.

Search. The entries of a codebook are sorted by the sum of their components. A part starts at its own sum and goes
outward, the entry with the nearer sum first. By Cauchy and Schwarz the squared gap of two sums, over the dimension, is
at most the squared distance; so the search stops once that strictly exceeds the best distance, and ties still meet.
All parts of a batch go outward in step.

Scale: a round reads the vectors in place, adds up sums and counts inside each task and sends a row for each entry and
component, whatever the number of vectors; codebooks (PARTS x ENTRIES entries) are all that the driver holds. Nothing is
shuffled by vector, so copies of a vector need no care. df is read once a round: write it first if it is dear. Sums by
label are partial aggregates, joined back where Spark may split a label of many rows.

Exact: 64-bit numbers where they can't overflow, whole numbers of any length elsewhere; sums travel in digits of 32 bits.

Defined cases. Vectors that are null or hold null or non-finite components take no part. An empty vector has parts
without components: code 0, error 0. Vectors of each dimension have codebooks of their own (dimensions are few: the
driver holds a row for each); where it isn't a multiple of PARTS, earlier parts are one component longer. Of equal ids the
least vector counts among the first ENTRIES; a null id comes after all others. Fewer ids: fewer entries. Repeated rows
count each. Errors beyond 64 bits are given as the largest 64-bit number. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.base import materialize, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
MOST = (1 << 63) - 1
#: Bits of a digit in which sums travel.
DIGIT = 32

#: Of one dimension: for each part the entries, each a list of whole numbers.
Codebooks = dict[int, list[list[list[int]]]]


def kept_vectors(df: DataFrame, key: str, vector: str, *others: str) -> DataFrame:
    """vec_id, x (array of double) and the others; rows that take part only."""
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda c: c.cast("double")).alias("x"), *others)
    return rows.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x): int64, or Python's integers where squares of gaps and sums could overflow."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * x)
    dim = max(1, x.shape[1])
    if not x.size or np.abs(scaled).max() * 4 * dim < 2.0**31:
        return scaled.astype(np.int64)
    return np.array([[int(np.floor(SCALE * c)) if abs(c) < 2.0**900 else SCALE * int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)


def borders(dim: int) -> list[tuple[int, int]]:
    """Where each part begins and ends."""
    short, longer = divmod(dim, PARTS)
    ends = [(p + 1) * short + min(p + 1, longer) for p in range(PARTS)]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry for each row of parts; ties to the lower index."""
    n, width = parts.shape
    sums = entries.sum(1)
    order = np.argsort(sums, kind="stable")
    sums, own, last = sums[order], parts.sum(1), len(entries) - 1
    right = np.searchsorted(sums, own)
    left = right - 1
    best, at = np.zeros(n, parts.dtype), np.full(n, -1)
    active = np.arange(n)
    while len(active):
        low, high = left[active], right[active]
        down, up = own[active] - sums[np.maximum(low, 0)], sums[np.minimum(high, last)] - own[active]
        leftward = (low >= 0) & ((high > last) | (down <= up))
        gap = np.where(leftward, down, up)
        go = ((low >= 0) | (high <= last)) & ((at[active] < 0) | (gap * gap <= best[active] * width))
        go = go.astype(bool)
        active, leftward = active[go], leftward[go]
        entry = order[np.where(leftward, left[active], right[active])]
        away = ((parts[active] - entries[entry]) ** 2).sum(1)
        better = ((at[active] < 0) | (away < best[active]) | ((away == best[active]) & (entry < at[active]))).astype(bool)
        best[active[better]], at[active[better]] = away[better], entry[better]
        left[active] -= leftward
        right[active] += ~leftward
    return at, best


def by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, whole numbers) of a batch's vectors."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        places = np.flatnonzero(sizes == dim)
        flat = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
        yield int(dim), places, whole_numbers(flat.reshape(len(places), int(dim)))


def assigned(vectors: np.ndarray, books: list[list[list[int]]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(begin, end, its components, index, squared distance) of each part."""
    dim = vectors.shape[1]
    flat = [abs(c) for book in books for entry in book for c in entry]
    large = vectors.dtype == object or (bool(flat) and max(flat) * 4 * max(1, dim) >= 1 << 31)
    for (begin, end), book in zip(borders(dim), books, strict=True):
        kind = object if large else np.int64
        own = vectors[:, begin:end].astype(kind)
        entries = np.array(book, kind).reshape(len(book), end - begin)
        yield begin, end, own, *nearest(own, entries)


def digits(n: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number in base 2^DIGIT; the last digit carries the sign."""
    place = 0
    while not -(1 << DIGIT) < n < 1 << DIGIT:
        yield place, n & ((1 << DIGIT) - 1)
        n, place = n >> DIGIT, place + 1
    yield place, n


def first_entries(vectors: DataFrame, entries: int = ENTRIES) -> Codebooks:
    """The codebooks at the start: parts of the vectors of least id, a few of which each task hands on."""
    last = lambda name: (name is None, name or 0)  # noqa: E731  null comes after all ids

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict] = defaultdict(dict)
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            ids = batch.column(0).to_pylist()
            for dim in np.unique(sizes):
                own = found[int(dim)]
                for i in sorted(np.flatnonzero(sizes == dim).tolist(), key=lambda i: last(ids[i])):
                    if ids[i] not in own and len(own) >= entries and last(ids[i]) > last(max(own, key=last)):
                        break
                    x = batch.column(1)[i].as_py()
                    own[ids[i]] = min(own.get(ids[i], x), x)
                for name in sorted(own, key=last)[entries:]:
                    del own[name]
        rows = [(dim, name, x) for dim, own in found.items() for name, x in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["dim", "vec_id", "x"])

    found = vectors.select("vec_id", "x").mapInArrow(least, "dim int, vec_id long, x array<double>").groupBy("dim", "vec_id").agg(F.min("x").alias("x"))
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last())  # ENTRIES rows of each task
    rows = found.withColumn("_row", F.row_number().over(order)).filter(F.col("_row") <= entries).orderBy("dim", "_row").collect()
    books: Codebooks = {}
    for dim in sorted({r.dim for r in rows}):
        own = [r.x for r in rows if r.dim == dim]
        whole = [[int(c) for c in row] for row in whole_numbers(np.array(own, float).reshape(len(own), dim))]
        books[dim] = [[row[begin:end] for row in whole] for begin, end in borders(dim)]
    return books


def next_entries(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries replaced by the floor of their parts' mean; unused ones stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int, int], int] = defaultdict(int)  # by dimension, part, entry and component (-1: their number)
        for batch in batches:
            for dim, _, whole in by_dimension(batch.column(0)):
                for part, (_, _, own, at, _) in enumerate(assigned(whole, shared.value[dim])):
                    for entry in np.unique(at).tolist():
                        mine = own[at == entry]
                        totals[dim, part, entry, -1] += len(mine)
                        for place, n in enumerate(mine.sum(0).tolist()):
                            totals[dim, part, entry, place] += n
        rows = [(*key, place, digit) for key, n in totals.items() for place, digit in digits(n)]
        names = ["dim", "part", "entry", "place", "digit", "n"]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in columns[:5]], pa.array(columns[5], pa.int64())], names=names)

    sums = vectors.select("x").mapInArrow(add, "dim int, part int, entry int, place int, digit int, n long")
    totals: dict[tuple[int, int, int, int], int] = defaultdict(int)
    for r in sums.groupBy("dim", "part", "entry", "place", "digit").agg(F.sum("n").alias("n")).collect():  # a row for each digit of each component of the codebooks
        totals[r.dim, r.part, r.entry, r.place] += r.n << (DIGIT * r.digit)
    return {
        dim: [
            [[totals[dim, p, e, i] // totals[dim, p, e, -1] for i in range(len(entry))] if totals.get((dim, p, e, -1)) else entry for e, entry in enumerate(book)]
            for p, book in enumerate(parts)
        ]
        for dim, parts in books.items()
    }


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> Codebooks:
    books = first_entries(vectors)
    for _ in range(rounds):
        books = next_entries(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vectors without x, with dim, code (two hex digits for each part) and error (squared distances summed over parts)."""
    vectors = vectors.select(*[c for c in vectors.columns if c not in ("x", "dim", "code", "error")], "x")
    kept = vectors.schema.fields[:-1]
    schema = T.StructType([*kept, T.StructField("dim", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    shared, names = vectors.sparkSession.sparkContext.broadcast(books), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, codes, errors = np.zeros(batch.num_rows, np.int32), np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, object)
            for dim, places, whole in by_dimension(batch.column(batch.num_columns - 1)):
                dims[places] = dim
                for part, (_, _, _, at, away) in enumerate(assigned(whole, shared.value[dim])):
                    codes[places, part] = at
                    errors[places] += away.astype(object)
            code = [bytes(c).hex() for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(dims), pa.array(code, pa.string()), pa.array([min(int(e), MOST) for e in errors], pa.int64())], names=names)

    return vectors.mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """codes with x: the entries that a code names, put together again and taken back to the scale of the input."""
    shared = codes.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([*codes.schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))])
    at, dim = codes.columns.index(code), codes.columns.index("dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [c / SCALE for book, entry in zip(shared.value[d], bytes.fromhex(k), strict=True) for c in book[entry]]
                for k, d in zip(batch.column(at).to_pylist(), batch.column(dim).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=schema.fieldNames())

    return codes.mapInArrow(run, schema)


def codebook_text(parts: list[list[list[int]]]) -> str:
    """All components by part, entry and place."""
    return ",".join(str(c) for book in parts for entry in book for c in entry)


def summed_by(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over rows of equal group (nulls are equal), at most the largest 64-bit number."""
    total: Column = F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = df.groupBy(F.col(group).alias("_group")).agg(total.alias(name))
    return df.join(sums, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def op13_equal_average_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every embedding, errors summed by label, and the digest of the final codebooks."""
    vectors = kept_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    books = fit(vectors)
    coded = materialize(encode(vectors, books), "vector-codes")
    digests = {dim: hashlib.sha256(codebook_text(parts).encode()).hexdigest() for dim, parts in books.items()}
    digest = F.lit(None).cast("string")
    for dim, text in digests.items():
        digest = F.when(F.col("dim") == dim, text).otherwise(digest)
    return summed_by(coded, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """A round after another, as common tables: near_r are assignments to book_r, book_r+1 what they leave."""
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"""
near_{r} as materialized (
    select k, p, min({{'d': d, 'e': e}}) as m from (
        select u.k, u.p, b.e, list_sum(list_transform(list_zip(u.u, b.u), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
        from parts u join book_{r} b on u.p = b.p) group by k, p)""")
        if r < ROUNDS:
            out.append(f"""
book_{r + 1} as materialized (
    select b.p, b.e, coalesce(n.u, b.u) as u from book_{r} b left join (
        select p, e, list(((s - ((s % c) + c) % c) // c)::bigint order by i) as u from (
            select n.p, n.m.e as e, i, sum(u.u[i])::bigint as s, count(*) as c
            from near_{r} n join parts u on n.k = u.k and n.p = u.p, range(1, 9) t(i) group by n.p, n.m.e, i) group by p, e) n
    on b.p = n.p and b.e = n.e)""")
    return ",".join(out)


#: Vectors of 64 components, as the table has.
OP13_SQL = f"""
with kept as materialized (
    select row_number() over (order by vec_id) as k, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select k, p, v[p * 8 + 1 : p * 8 + 8] as u from kept, range({PARTS}) t(p)),
book_0 as materialized (select p, k - 1 as e, u from parts where k <= {ENTRIES}),{_rounds_sql()},
digest as (select sha256(string_agg(array_to_string(u, ','), ',' order by p, e)) as codebooks_sha256 from book_{ROUNDS}),
coded as (
    select k, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' order by p) as code, sum(m.d)::bigint as error from near_{ROUNDS} group by k)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
from coded join kept using (k), digest"""
