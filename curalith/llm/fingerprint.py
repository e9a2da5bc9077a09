"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text becomes tokens: its words, long ones cut into pieces.  A run of K tokens
is an anchor (a closed syncmer) if the smallest hash among its runs of S tokens
stands first or last in it.  That depends on the K tokens alone, so an edit
changes no anchor that doesn't overlap it, wherever the text has shifted to.  A
fingerprint holds all anchor hashes of a text in the order of their positions;
two fingerprints are as alike as the share of anchors that match in one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalith.llm.quality import SPACE, let

#: Tokens of an anchor and of the runs within it.
K, S = 5, 2
#: Code points of a token at most.
PIECE = 6
#: The lower half of a packed pair of numbers.
LOW = 0xFFFFFFFF


def tokens(text: Column) -> Column:
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), rf"([^\x20\x09-\x0D]{{{PIECE}}})(?=[^\x20\x09-\x0D])", "$1 ")
    trimmed = F.trim(cut, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def anchors(text: Column) -> Column:
    """The hashes of all of the text's anchors (32 bits) in its order, repeated ones as often as they occur; empty without a token.

    K - 1 marks stand before the first token, so that short texts have runs too;
    the first run always counts.
    """
    marks = F.array(*[F.lit(-1 - i).cast("bigint") for i in range(K - 1)])
    inner = K - S + 1  # runs of S tokens in a run of K

    def select(h: Column, m: Column) -> Column:
        def anchor(x: Column, i: Column) -> Column:
            edge = F.least(x, F.get(m, i + (inner - 1)))
            middle = F.least(*[F.get(m, i + j) for j in range(1, inner - 1)])
            return F.when((edge <= middle) | (i == 0), F.xxhash64(*[F.get(h, i + j) for j in range(K)]).bitwiseAND(F.lit(LOW)))

        runs = F.slice(m, 1, F.greatest(F.size(m) - (inner - 1), F.lit(0)))
        return F.array_compact(F.transform(runs, anchor))

    def of_hashes(h: Column) -> Column:
        m = F.transform(F.slice(h, 1, F.size(h) - (S - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, S)]))
        return let(m, lambda m: select(h, m))

    found = let(F.concat(marks, F.transform(tokens(text), lambda t: F.xxhash64(t))), of_hashes)
    return F.when(F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE)) == "", F.array().cast("array<bigint>")).otherwise(found)


def _packed(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("bigint"), 32).bitwiseOR(low.cast("bigint"))


def _same_start(a: Column, b: Column) -> Column:
    """Number of first elements that two arrays have in common."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def _starts(x: Column, follows) -> Column:
    """Indices of the elements that don't follow their predecessor: where runs start."""
    return F.array_compact(F.transform(x, lambda e, k: F.when((k == 0) | ~F.coalesce(follows(F.get(x, k - 1), e), F.lit(False)), k)))


def _pairs(a: Column, b: Column) -> Column:
    """Positions in both arrays, packed, of a hash's first occurrence in each, its second in each, and so on."""
    side = 1 << 31
    merged = F.sort_array(F.concat(F.transform(a, lambda x, i: _packed(x, i)), F.transform(b, lambda x, i: _packed(x, i.bitwiseOR(F.lit(side))))))

    def of_runs(s: Column, t: Column) -> Column:  # a run is a hash's occurrences in one of the arrays
        kind = lambda r: F.shiftright(F.get(s, F.get(t, r)), 31)
        both = F.array_compact(F.transform(t, lambda _, r: F.when((r > 0) & (kind(r).bitwiseAND(F.lit(1)) == 1) & (kind(r) - 1 == kind(r - 1)), r)))
        start = lambda r: F.coalesce(F.get(t, r), F.size(s))
        steps = lambda r: F.sequence(F.lit(0), F.least(start(r) - start(r - 1), start(r + 1) - start(r)) - 1)
        place = lambda i: F.get(s, i).bitwiseAND(F.lit(side - 1))
        return F.flatten(F.transform(both, lambda r: F.transform(steps(r), lambda k: _packed(place(start(r - 1) + k), place(start(r) + k)))))

    return let(merged, lambda s: let(_starts(s, lambda x, y: F.shiftright(x, 31) == F.shiftright(y, 31)), lambda t: of_runs(s, t)))


def _longest_chain(ranks: Column) -> Column:
    """Length of the longest ascending subsequence of a permutation of 0, 1, ...

    Runs of successive numbers go as a whole: no other element lies within one,
    in position or value.  The state has (last number, length) of the chains
    that none with a smaller last number is as long as.
    """

    def extend(chains: Column, run: Column) -> Column:
        value = F.shiftleft(F.shiftright(run, 32), 32)

        def grown(below: Column) -> Column:
            length = F.coalesce(F.get(below, F.size(below) - 1).bitwiseAND(F.lit(LOW)), F.lit(0)) + run.bitwiseAND(F.lit(LOW))
            return let(length, lambda n: F.concat(below, F.array(value.bitwiseOR(n)), F.filter(chains, lambda c: (c > value) & (c.bitwiseAND(F.lit(LOW)) > n))))

        return let(F.filter(chains, lambda c: c < value), grown)

    def of_runs(v: Column, t: Column) -> Column:
        runs = F.transform(t, lambda at, r: _packed(F.get(v, at), F.coalesce(F.get(t, r + 1), F.size(v)) - at))
        chains = F.aggregate(runs, F.array().cast("array<bigint>"), extend, lambda chains: F.element_at(chains, -1).bitwiseAND(F.lit(LOW)))
        return F.when(F.size(t) <= 1, F.size(v).cast("bigint")).otherwise(chains)

    return let(ranks, lambda v: let(_starts(v, lambda x, y: x + 1 == y), lambda t: of_runs(v, t)))


def _matches(a: Column, b: Column) -> Column:
    """Elements that match in one order: the common start, the common end, and the longest chain of pairs between."""

    def between(x: Column, y: Column) -> Column:
        in_b = lambda p: F.sort_array(F.transform(p, lambda e, k: _packed(e.bitwiseAND(F.lit(LOW)), k)))
        ranks = let(F.sort_array(_pairs(x, y)), lambda p: F.transform(in_b(p), lambda e: e.bitwiseAND(F.lit(LOW))))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0).cast("bigint")).otherwise(_longest_chain(ranks))

    def without_end(x: Column, y: Column) -> Column:
        head = lambda z, n: F.slice(z, F.lit(1), F.size(z) - n)
        return let(_same_start(F.reverse(x), F.reverse(y)), lambda n: n + let(head(x, n), lambda x: let(head(y, n), lambda y: between(x, y))))

    rest = lambda z, n: F.slice(z, n + 1, F.size(z) - n)
    return let(_same_start(a, b), lambda n: n + let(rest(a, n), lambda x: let(rest(b, n), lambda y: without_end(x, y))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: anchors that match in one order, against all of both; two empty fingerprints are alike."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(let(_matches(a, b), lambda n: n / (total - n)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every row's text as a string; map-only."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_text(anchors(F.col("text"))).alias("fingerprint"))


def _ranges(docs: DataFrame, count: int) -> tuple[list[int], int | None, bool]:
    """(first ids of all ranges but the first, smallest id, whether an id is null)."""
    steps = [i / count for i in range(1, count)]
    found = docs.agg(
        (F.percentile_approx("doc_id", steps, max(10_000, 20 * count)) if steps else F.lit(None).cast("array<bigint>")).alias("p"),
        F.min("doc_id").alias("low"),
        F.count_if(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    low = found["low"]
    return sorted({x for x in found["p"] or [] if x is not None and x > low}), low, bool(found["nulls"])


def _range_of(starts: list[int]) -> Column:
    """Number of starts <= doc_id (0 for null), by two steps of about the square root of their number each."""
    if not starts:
        return F.lit(0)
    step = max(1, int(len(starts) ** 0.5))
    blocks = [starts[i : i + step] for i in range(0, len(starts), step)]
    array = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    at_most = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    outer = let(at_most(array([b[0] for b in blocks])), lambda n: F.when(n == 0, F.lit(0)).otherwise((n - 1) * step + at_most(F.get(F.array(*[array(b) for b in blocks]), n - 1))))
    return F.coalesce(outer, F.lit(0))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text has the last floor(n / 4) code points replaced by the first
    as many of the next document (ascending doc_id, null first, equal ids by
    text; after the last comes the first).  A null text counts as empty.  One
    row per row of ``docs``.

    Documents are dealt into ranges of ids, in which a window finds the next
    one; the first document of a range goes to the range before it as well, so
    one exchange of the texts is all, and no range sees more than its share.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    starts, low, nulls = _ranges(ids.select("doc_id"), max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(low)
    own = ids.withColumn("rng", _range_of(starts))
    opens = F.col("doc_id").isin(starts) if len(starts) <= 10 else F.coalesce(F.get(F.array(*[F.lit(x).cast("bigint") for x in starts]), F.col("rng") - 1) == F.col("doc_id"), F.lit(False))
    places = F.array_compact(
        F.array(
            F.struct(F.lit(False).alias("extra"), F.col("rng").alias("rng")),
            F.when(F.coalesce(opens, F.lit(False)), F.struct(F.lit(True).alias("extra"), (F.col("rng") - 1).alias("rng"))),
            F.when(F.coalesce(first, F.lit(False)), F.struct(F.lit(True).alias("extra"), F.lit(len(starts)).alias("rng"))),
        )
    )
    # prints are made behind the exchange and the sort: they are about as large as the texts
    dealt = own.select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", "place.rng", "place.extra").repartition("rng")
    within = ["extra", F.col("doc_id").asc_nulls_first(), "text"]
    printed = dealt.sortWithinPartitions("rng", *within).withColumn("print", anchors(F.col("text")))
    order = Window.partitionBy("rng").orderBy(*within)
    quarter = F.floor(F.length("text") / 4).cast("int")
    paired = printed.select("doc_id", "text", "print", "extra", F.lead("text").over(order).alias("next_text"), F.lead("print").over(order).alias("next_print")).where(~F.col("extra"))
    edited = paired.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), "print", "next_print", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.when(quarter > 0, F.substring("next_text", F.lit(1), quarter)).otherwise(F.lit(""))).alias("edited")
    )
    both = edited.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "print", "next_print", anchors(F.col("edited")).alias("edited_print"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
