"""How often every term, and every sequence of up to sigma terms, occurs, and in how many records.

A record's suffixes, truncated to sigma terms, stand for all sequences that begin where they begin.  They are routed by
their first term, sorted in reverse lexicographic order, and one pass with a stack adds up the counts of all prefixes:
when the next suffix no longer begins with an open prefix, that prefix is complete and is put out.  The pass works on
whole Arrow batches; where the common prefix of neighbours ends, an entry of the stack is popped, and what is open at
the end of a batch is carried on.

The set of records of a sequence is kept as a count: a suffix brings, for each prefix length, whether its record has
that prefix here for the first time.  As a record is one row, these flags are exact and no record ids are gathered.

Equal suffixes are added up within each task before they are shuffled.  A first term with a large share of the rows that
a task holds is routed to several partitions, by a salt from the whole suffix, so no partition gets all suffixes of a
term in a third of all rows; the prefixes' counts of the partitions are added up in the end.

Defined results: null terms are left out before sequences are formed; records without terms, and null records, have no
sequences; repeated records count each; an empty table has no rows; other columns are not read, so their names don't
matter.  Terms are integers or strings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shipping import ship

SALTS = 32
#: A first term is salted where it has more than this share of the rows that a task holds.
HOT_SHARE = 1 / 64
#: Rows that a task holds to combine them, rows of a batch that it passes on, and terms whose suffixes are formed at once.
COMBINED_ROWS, OUT_ROWS, PART_TERMS = 1 << 19, 1 << 16, 1 << 18


def _names(sigma: int) -> tuple[list[str], list[str]]:
    return [f"t{i + 1}" for i in range(sigma)], ["n"] + [f"d{i + 1}" for i in range(sigma)]


def _parts(column: pa.ListArray, most: int) -> Iterator[pa.ListArray]:
    """Runs of records with about `most` terms each; a longer record is one of its own."""
    upto = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)) // most
    heads = np.flatnonzero(np.diff(upto, prepend=-1))
    for a, b in zip(heads, [*heads[1:], len(column)]):
        yield column.slice(int(a), int(b - a))


def record_suffixes(batches: Iterator[pa.RecordBatch], sigma: int, most: int = PART_TERMS) -> Iterator[pa.RecordBatch]:
    """From records (an array of terms each) to their truncated suffixes (t1..ts, n, d1..ds)."""
    terms, sums = _names(sigma)
    for batch in batches:
        for part in _parts(batch.column(0), most):
            record, value = pc.list_parent_indices(part).to_numpy(), pc.list_flatten(part)
            there = value.is_valid().to_numpy(zero_copy_only=False)
            record, value = record[there], value.filter(pa.array(there))
            size = len(value)
            if not size:
                continue
            code = pc.dictionary_encode(value).indices.to_numpy().astype(np.int64)
            place = np.arange(size)
            # A sequence of one record is a number: that of its first terms and the code of its last one.
            group, columns, flags = record.astype(np.int64), [], []
            for length in range(1, sigma + 1):
                at = place + length - 1
                inside = at < size
                at = np.minimum(at, size - 1)
                inside &= record[at] == record
                columns.append(value.take(pa.array(at, mask=~inside)))
                group[inside] = group[inside] * size + code[at[inside]]
                _, first, inverse = np.unique(group[inside], return_index=True, return_inverse=True)
                new = np.zeros(size, np.int64)
                new[place[inside][first]] = 1
                group[inside] = inverse
                flags.append(pa.array(new))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.ones(size, np.int64)), *flags], [*terms, *sums])


def combine(batches: Iterator[pa.RecordBatch], sigma: int, rows: int = COMBINED_ROWS, salts: int = SALTS) -> Iterator[pa.RecordBatch]:
    """Equal suffixes of a task added up, as far as they lie within about `rows` rows, with the salt of their route."""
    terms, sums = _names(sigma)

    def added(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).group_by(terms, use_threads=False).aggregate([(c, "sum") for c in sums])
        table = table.select([*terms, *(f"{c}_sum" for c in sums)]).rename_columns([*terms, *sums])
        salt = np.zeros(len(table), np.int32)
        if sigma > 1:
            first = table.column("t1").combine_chunks().dictionary_encode("encode").indices.to_numpy()
            count = np.bincount(first)
            hot = np.flatnonzero((count > HOT_SHARE * rows)[first])
            # Any spread will do, as counts are added up afterwards: here, by turns.
            salt[hot] = np.arange(len(hot)) % salts
        yield from table.append_column("salt", pa.array(salt)).to_batches(max_chunksize=OUT_ROWS)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield from added(held)
            held, size = [], 0
    if size:
        yield from added(held)


def _changes(column: pa.Array, last) -> np.ndarray:
    """Where a value differs from the one before; null equals null. last: the value before the first."""
    before = pa.concat_arrays([pa.array([last], column.type), column.slice(0, len(column) - 1)])
    same = pc.fill_null(pc.equal(column, before), False)
    return ~pc.or_(same, pc.and_(pc.is_null(column), pc.is_null(before))).to_numpy(zero_copy_only=False)


def prefix_sums(batches: Iterator[pa.RecordBatch], sigma: int, lengths: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """From sorted (t1..ts, n, d1..ds) to (t1..ts, length, n, d) of every prefix of these lengths."""
    open_: list[list | None] = [None] * sigma  # per length: [terms, n, d]
    names = [f"t{i + 1}" for i in range(sigma)] + ["length", "n", "d"]
    types: list[pa.DataType] = []

    def out(columns: list[pa.Array], length: int, n, d) -> pa.RecordBatch:
        size = len(n)
        terms = [columns[i] if i < length else pa.nulls(size, types[i]) for i in range(sigma)]
        return pa.RecordBatch.from_arrays([*terms, pa.array(np.full(size, length, np.int32)), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names)

    def popped(length: int) -> pa.RecordBatch:
        terms, n, d = open_[length - 1]
        return out([pa.array([t], types[i]) for i, t in enumerate(terms)], length, [n], [d])

    last: list | None = None
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        columns = [batch.column(i) for i in range(sigma)]
        types = [c.type for c in columns]
        n = batch.column(sigma).to_numpy()
        changed = np.zeros(size, bool)
        for length in range(1, max(lengths) + 1):
            c = columns[length - 1]
            changed = changed | _changes(c, last[length - 1] if last else None)
            if last is None:
                changed[0] = True
            if length not in lengths:
                continue
            d = batch.column(sigma + length).to_numpy()
            heads = np.flatnonzero(changed)
            if not len(heads) or heads[0] != 0:
                heads = np.append(0, heads)
            ns, ds = np.add.reduceat(n, heads), np.add.reduceat(d, heads)
            stack = open_[length - 1]
            if stack is not None:
                if changed[0]:
                    yield popped(length)
                else:
                    ns[0] += stack[1]
                    ds[0] += stack[2]
            is_there = c.take(pa.array(heads)).is_valid().to_numpy(zero_copy_only=False)
            done = np.flatnonzero(is_there[:-1])
            if len(done):
                rows = pa.array(heads[done])
                yield out([columns[i].take(rows) for i in range(length)], length, ns[done], ds[done])
            open_[length - 1] = [[columns[i][size - 1].as_py() for i in range(length)], int(ns[-1]), int(ds[-1])] if is_there[-1] else None
        last = [c[size - 1].as_py() for c in columns]
    for length in lengths:
        if open_[length - 1] is not None:
            yield popped(length)


def sequence_counts(df: DataFrame, terms: str, sigma: int, lengths: Sequence[int] | None = None, salts: int = SALTS) -> DataFrame:
    """(t1..ts, length, occurrences, records) of every sequence of up to sigma terms of the array column `terms`.

    lengths: which lengths are put out, by default all from 1 to sigma; terms beyond a sequence's length are null.
    """
    lengths = sorted(set(lengths or range(1, sigma + 1)))
    if sigma < 1 or lengths[0] < 1 or lengths[-1] > sigma:
        raise ValueError("lengths from 1 to sigma")
    ship(df.sparkSession)
    kind = df.schema[terms].dataType.elementType
    names, sums = _names(sigma)
    columns = [T.StructField(t, kind) for t in names]
    suffix = T.StructType([*columns, *(T.StructField(c, T.LongType()) for c in sums), T.StructField("salt", T.IntegerType())])
    prefix = T.StructType([*columns, T.StructField("length", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("d", T.LongType())])
    suffixes = df.select(F.col(f"`{terms}`").alias("terms")).mapInArrow(lambda it: combine(record_suffixes(it, sigma), sigma, salts=salts), suffix)
    ordered = suffixes.repartition("t1", "salt").sortWithinPartitions(*(F.desc(t) for t in names))
    prefixes = ordered.mapInArrow(lambda it: prefix_sums(it, sigma, lengths), prefix)
    shown = [t for i, t in enumerate(names) if i < lengths[-1]]
    if sigma > 1:
        prefixes = prefixes.groupBy(*shown, "length").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return prefixes.select(*shown, "length", F.col("n").alias("occurrences"), F.col("d").alias("records"))


def row_counts(df: DataFrame, columns: Sequence[str], lengths: Sequence[int] | None = None) -> DataFrame:
    """sequence_counts() of rows as records, whose terms are the fields in these columns, in this order and of one type."""
    return sequence_counts(df.select(F.array(*(F.col(f"`{c}`") for c in columns)).alias("terms")), "terms", len(columns), lengths)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(value, occurrences, records) of every value in any of the columns: a row's sequences of one term."""
    return row_counts(df, columns, [1]).select(F.col("t1").alias("value"), "occurrences", "records")


def marked(counts: DataFrame, total_records: int, rare: int = 2, common: float = 0.02) -> DataFrame:
    """Add `mark`: 'rare' in at most `rare` records, else 'common' in at least that share of all records, else null."""
    least = math.ceil(round(common * total_records, 6))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") >= least, "common")
    return counts.withColumn("mark", mark)
