"""Records of evaluation splits that also stand, exactly or almost, in the training split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.skew import join_salted
from ..plans.stage import drop_stage, stage
from .chars import chunks, mixed, words

#: MinHash bands and rows in each.  Word bags that share 80% of the longer have a Jaccard index of 2/3 or more, and are
#: found with a probability of 0.99 (0.9995 where they share 85%).
BANDS, ROWS = 36, 5
#: 64-bit words of a record's bit mask; half of them, folded, travel with its bands.
MASKS = 4
TRAIN, EVALUATION = ("train",), ("validation", "test")


def canonical(text: Column) -> Column:
    """Words in lower case with one space between: case, punctuation and white space don't count."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bag_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text numbered by occurrence, as hashes: bags become sets.  Also where each text's tokens begin."""
    hashes, bounds = words(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(h) else at
    return mixed(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), bounds


def _factors() -> np.ndarray:
    return mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_keys(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each text (all of which must have tokens)."""
    out = np.zeros((BANDS, len(starts)), np.uint64)
    for i, a in enumerate(_factors()):
        least = np.minimum.reduceat((tokens * a) >> np.uint64(32), starts)
        out[i // ROWS] = mixed(out[i // ROWS] + least + np.uint64(i))
    return out.view(np.int64).T


def bit_masks(tokens: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 * MASKS bits for each text, set at the tokens' hashes."""
    flags = np.zeros((len(starts), 64 * MASKS), np.uint8)
    flags[np.repeat(np.arange(len(starts)), counts), (tokens % np.uint64(64 * MASKS)).astype(np.int64)] = 1
    return np.packbits(flags, axis=1).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("canon").to_pylist()
        for at, some in chunks(texts):
            tokens, bounds = bag_tokens(some)
            n = np.diff(bounds)
            full = np.flatnonzero(n > 0)
            if not len(full):
                continue
            starts = bounds[:-1][full]
            bands, masks = band_keys(tokens, starts), bit_masks(tokens, starts, n[full])
            where = pa.array(at + full)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(where) for c in ("kind", "cid", "n_train", "n_eval")),
                    pa.array(n[full].astype(np.int32)),
                    *(pa.array(np.ascontiguousarray(masks[:, k])) for k in range(MASKS)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (len(full) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.ravel())),
                ],
                names=["kind", "cid", "n_train", "n_eval", "n", *(f"w{k}" for k in range(MASKS)), "bands"],
            )


def shared_words(left: list[str], right: list[str]) -> np.ndarray:
    """For each pair of texts: words in common, counted with repetition, times 5, minus 4 times those of the longer."""
    a, ab = bag_tokens(left)
    b, bb = bag_tokens(right)
    pair = np.append(np.repeat(np.arange(len(left)), np.diff(ab)), np.repeat(np.arange(len(right)), np.diff(bb)))
    both = np.append(a, b)
    order = np.lexsort((both, pair))
    both, pair = both[order], pair[order]
    twice = (both[1:] == both[:-1]) & (pair[1:] == pair[:-1])
    common = np.bincount(pair[1:][twice], minlength=len(left))
    return common * 5 - 4 * np.maximum(np.diff(ab), np.diff(bb))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("canon_e").to_pylist(), batch.column("canon_t").to_pylist()
        ok = np.zeros(batch.num_rows, bool)
        at = 0
        while at < batch.num_rows:  # parts of about a million letters
            end, size = at, 0
            while end < batch.num_rows and (end == at or size + len(left[end]) + len(right[end]) <= 1 << 20):
                size += len(left[end]) + len(right[end])
                end += 1
            ok[at:end] = shared_words(left[at:end], right[at:end]) >= 0
            at = end
        yield batch.select(["cid_e", "cid_t"]).filter(pa.array(ok))


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): records of equal canonical text share a class.

    records: kind, key, text, split, source.  Rows with a null key, a null text or one without a word are no cases.  A
    class of any size is one row, made by partial aggregation.
    """
    split = F.lower(F.col("split"))
    side = F.when(split.isin(*TRAIN), F.lit("t")).when(split.isin(*EVALUATION), F.lit("e"))
    rows = records.select("kind", F.col("key").cast("string").alias("key"), F.col("split"), F.col("source"), side.alias("side"), canonical(F.col("text")).alias("canon"))
    rows = rows.where(F.col("key").isNotNull() & F.col("side").isNotNull() & (F.col("canon") != ""))
    rows = rows.withColumn("digest", F.unhex(F.substring(F.sha2(F.concat_ws(" ", "kind", "canon"), 256), 1, 32)))
    one = rows.groupBy("digest").agg(
        F.first("kind").alias("kind"), F.first("canon").alias("canon"), F.count_if(F.col("side") == "t").alias("n_train"), F.count_if(F.col("side") == "e").alias("n_eval")
    )
    found = stage(one.withColumn("cid", F.monotonically_increasing_id()), "classes")
    return found, rows.select("kind", "key", "split", "source", "side", "digest")


def near_links(found: DataFrame) -> DataFrame:
    """(cid_e, cid_t): different classes, one with evaluation and one with training records, that share at least 80%
    of the words of the longer text.

    MinHash bands propose pairs, by keys of 64 bits; a band that many classes share is spread over all tasks.  Bit counts
    drop pairs that cannot reach 80%, without losing one: folded masks while the bands are joined, whole ones after
    each pair is there once.  The words decide.
    """
    fields = [T.StructField("kind", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("cid", "n_train", "n_eval")), T.StructField("n", T.IntegerType())]
    fields += [*(T.StructField(f"w{k}", T.LongType()) for k in range(MASKS)), T.StructField("bands", T.ArrayType(T.LongType()))]
    signed = found.select("kind", "cid", "n_train", "n_eval", "canon").mapInArrow(_signatures, T.StructType(fields))
    posted = stage(signed, "signatures")

    half = MASKS // 2

    def possible(pairs: DataFrame, m: str, k: int) -> DataFrame:
        """Without pairs whose lengths, or whose bits that the other lacks, leave less than 80%: no other pair is lost."""
        only = lambda a, b: sum((F.bit_count(F.col(f"{m}{i}_{a}").bitwiseAND(F.bitwise_not(F.col(f"{m}{i}_{b}")))) for i in range(k)), F.lit(0))
        longer = F.greatest("n_e", "n_t") * 4
        return pairs.where((F.least("n_e", "n_t") * 5 >= longer) & ((F.col("n_e") - only("e", "t")) * 5 >= longer) & ((F.col("n_t") - only("t", "e")) * 5 >= longer))

    def postings(side: str, s: str) -> DataFrame:
        folded = [F.col(f"w{i}").bitwiseOR(F.col(f"w{i + half}")).alias(f"m{i}_{s}") for i in range(half)]
        rows = posted.where(F.col(side) > 0).select("kind", F.col("cid").alias(f"cid_{s}"), F.col("n").alias(f"n_{s}"), *folded, F.explode("bands").alias("band"))
        return rows.withColumn("band", F.xxhash64("kind", "band")).drop("kind")

    met = join_salted(postings("n_eval", "e"), postings("n_train", "t"), "band", "cid_t").where(F.col("cid_e") != F.col("cid_t"))
    met = possible(met, "m", half).select("cid_e", "cid_t").distinct()
    facts = lambda s: posted.select(F.col("cid").alias(f"cid_{s}"), F.col("n").alias(f"n_{s}"), *(F.col(f"w{i}").alias(f"w{i}_{s}") for i in range(MASKS)))
    pairs = possible(met.join(facts("e"), "cid_e").join(facts("t"), "cid_t"), "w", MASKS).select("cid_e", "cid_t")
    texts = found.select("cid", "canon")
    with_text = pairs.join(texts.select(F.col("cid").alias("cid_e"), F.col("canon").alias("canon_e")), "cid_e").join(texts.select(F.col("cid").alias("cid_t"), F.col("canon").alias("canon_t")), "cid_t")
    links = stage(with_text.select("cid_e", "cid_t", "canon_e", "canon_t").mapInArrow(_verified, "cid_e long, cid_t long"), "links")
    drop_stage(posted)
    return links


def overlaps(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): every record with its class, and all links between an evaluation and a training class.

    links: digest_e, digest_t, exact (the two classes are one).  Nothing is emitted within a class, so a group of
    copies, however large, costs one link.  An empty table gives no rows; other columns are ignored.
    """
    found, members = classes(records)
    near = near_links(found)
    name = found.select("cid", "digest")
    linked = near.join(name.select(F.col("cid").alias("cid_e"), F.col("digest").alias("digest_e")), "cid_e").join(name.select(F.col("cid").alias("cid_t"), F.col("digest").alias("digest_t")), "cid_t")
    same = found.where("n_train > 0 and n_eval > 0").select(F.col("digest").alias("digest_e"), F.col("digest").alias("digest_t"), F.lit(True).alias("exact"))
    return members, stage(linked.select("digest_e", "digest_t", F.lit(False).alias("exact")).unionByName(same), "overlaps")


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b): all pairs of an evaluation and a training record whose classes are linked, smaller key first."""
    end = lambda s: stage(members.where(F.col("side") == s).select(F.col("digest").alias(f"digest_{s}"), F.col("key").alias(s)).distinct(), "members")
    some = stage(join_salted(links, end("e"), "digest_e", "e"), "ends")
    pairs = join_salted(some, end("t"), "digest_t", "t").where(F.col("e") != F.col("t"))
    return pairs.select(F.least("e", "t").alias("key_a"), F.greatest("e", "t").alias("key_b")).distinct()


def report(members: DataFrame, links: DataFrame) -> DataFrame:
    """Evaluation records by kind, split and source: all, with an exact and with a near match in train."""
    hit = links.groupBy("digest_e").agg(F.bool_or("exact").alias("exact"), F.bool_or(~F.col("exact")).alias("near"))
    rows = members.where("side = 'e'").join(hit.withColumnRenamed("digest_e", "digest"), "digest", "left")
    return rows.groupBy("kind", "split", "source").agg(F.count("*").alias("records"), F.count_if("exact").alias("exact"), F.count_if("near").alias("near"))
