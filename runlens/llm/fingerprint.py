"""Order MinHash fingerprints, in built-in functions only: like texts by edit distance have like fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runlens.llm.blocks import table

# A token is a run without white space, cut after 16 characters; a k-mer is two tokens that follow each other.
TOKEN = r"\S{1,16}"
# The top bits of a k-mer's hash choose one of 64 places of the signature, the low bits of a packed number hold its
# place in the text.
BINS = 6
PLACE = 24
LOW = (1 << PLACE) - 1


def _packed(hashed: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftright(hashed, PLACE), PLACE).bitwiseOR(place.bitwiseAND(F.lit(LOW)))


def kmers(text: Column) -> Column:
    """Hash (40 bits) and place (24 bits) of every k-mer, in the order of the hash."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    bound = F.transform(
        F.array(tokens), lambda t: F.transform(t, lambda x, i: _packed(F.xxhash64(x, F.get(t, i + 1)), i.cast("long")))
    )
    return F.sort_array(bound[0])


def numbered(sorted_kmers: Column) -> Column:
    """Each k-mer hashed with its occurrence number, in the order of that hash.

    Equal k-mers follow each other, in text order. The runs are found first; each gives its own occurrences.
    """
    size = F.size(sorted_kmers)

    def same(i: Column) -> Column:
        return F.shiftright(F.get(sorted_kmers, i), PLACE) == F.shiftright(F.get(sorted_kmers, i - 1), PLACE)

    indices = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(indices, lambda i: (i == 0) | ~same(i))

    def occurrences(begins: Column) -> Column:
        def run(begin: Column, j: Column) -> Column:
            end = F.coalesce(F.get(begins, j + 1), size)
            own = F.slice(sorted_kmers, begin + 1, end - begin)
            return F.transform(own, lambda x, n: _packed(F.xxhash64(F.shiftright(x, PLACE), n), x))

        return F.flatten(F.transform(begins, run))

    return F.sort_array(F.transform(F.array(starts), occurrences)[0])


def signature(sorted_numbered: Column) -> Column:
    """For each of 64 bins that has one, the tuple of its two minimal numbered k-mers in text order, hashed: 32 bits, the bin in the top."""

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, 64 - BINS)

    def of_bin(x: Column, i: Column) -> Column:
        return (i < 2) | (bin_of(F.get(sorted_numbered, i - 2)) != bin_of(x))

    least = F.filter(sorted_numbered, of_bin)

    def tuples(chosen: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            other = F.get(chosen, i + 1)
            other = F.when(bin_of(other) == bin_of(x), other)
            a, b = F.shiftright(x, PLACE), F.shiftright(other, PLACE)
            later = x.bitwiseAND(F.lit(LOW)) > other.bitwiseAND(F.lit(LOW))
            hashed = F.when(F.coalesce(later, F.lit(False)), F.xxhash64(b, a)).otherwise(F.xxhash64(a, b))
            entry = F.shiftleft(bin_of(x), 32 - BINS).bitwiseOR(F.shiftrightunsigned(hashed, 32 + BINS))
            first = (i == 0) | (bin_of(F.get(chosen, i - 1)) != bin_of(x))
            return F.when(first, entry)

        return F.filter(F.transform(chosen, one), lambda e: e.isNotNull())

    return F.transform(F.array(least), tuples)[0]


def likeness(a: Column, b: Column) -> Column:
    """Share of bins, of those that either signature has, with equal tuples; two empty signatures are alike."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32 - BINS)), F.transform(b, lambda x: F.shiftright(x, 32 - BINS))))
    return F.when(bins == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / bins)


def as_text(a: Column) -> Column:
    """Eight hexadecimal digits per bin."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``; each step is a column of its own, so that no step is computed anew per element of the next."""
    steps = df.withColumn("k_", kmers(F.col(text)))
    steps = steps.withColumn("n_", numbered(F.col("k_"))).drop("k_")
    return steps.withColumn(out, signature(F.col("n_"))).drop("n_")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs``.

    The next document is the next row in the order (doc_id, hash of text, text), after the last the first. Nulls: a
    null text is empty, a null id comes before all others. Repeated rows follow each other; an empty table gives no
    rows; other columns are not read. Texts of more than 2^24 tokens keep their order only modulo that number.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ranges of ids, about as many as partitions; uneven ranges cost balance only.
    shares = [(i + 1) / parts for i in range(parts - 1)] or [0.5]
    bounds = ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit(s) for s in shares]), F.lit(20 * parts))).first()[0] or []
    bounds = sorted(set(bounds))
    edges = F.array(*[F.lit(b) for b in bounds]).cast(f"array<{docs.schema['doc_id'].dataType.simpleString()}>")
    bucket = F.size(F.filter(edges, lambda b: b < F.col("doc_id")))
    heads = ids.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(
        F.min("doc_id").alias("doc_id"), F.bool_or(F.col("doc_id").isNull()).alias("no_id")
    )
    heads = sorted((r["bucket"], None if r["no_id"] else r["doc_id"]) for r in heads.collect())  # one row per range
    kind = docs.schema["doc_id"].dataType.simpleString()
    following = [(heads[i - 1][0], heads[i][1]) for i in range(len(heads))]
    after = spark.createDataFrame(following, f"bucket int, head {kind}")
    tie = F.xxhash64("text")
    first = F.min_by("text", F.struct(tie, F.col("text")))
    firsts = rows.join(F.broadcast(after), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("bucket").agg(first.alias("first"))
    firsts = with_signature(firsts, "first", "first_sig")

    order = W.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "tie", "text")
    read = rows.withColumn("bucket", bucket).withColumn("tie", tie)
    read = read.select("doc_id", "bucket", "tie", "text", F.lead("text").over(order).alias("next"), F.row_number().over(order).alias("place"))
    read = read.join(firsts, "bucket", "left")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", "first"), F.lit(1), half))
    read = read.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    read = with_signature(with_signature(read, "text", "sig"), "edited", "edited_sig")
    slim = read.select("doc_id", "bucket", "place", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sig", "edited_sig", "first_sig")
    following_sig = F.coalesce(F.lead("sig").over(W.partitionBy("bucket").orderBy("place")), F.col("first_sig"))
    return slim.withColumn("next_sig", following_sig).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op4(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
