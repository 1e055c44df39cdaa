"""Operator 10: exact n-gram Jaccard join over parity sketches.

A document's set holds its distinct word shingles as 64-bit hashes. The set's
parity sketch has one 64-bit word per part: every shingle XORs its hash into
the part that its high bits choose. One shingle of difference changes one
part at most, so the number of unlike parts is a lower bound of the symmetric
difference, and two sets within Jaccard ``t`` differ in at most
``(1-t)/(1+t) * (|A|+|B|)`` parts. Sketches therefore have more parts than
that bound per size band, and linked sets agree in at least one part
(pigeonhole). Documents that share a part are candidates; a parity sketch of
single bits, about as many as the set has shingles, bounds the difference
again (of two widths, the wider folds onto the other); the sets decide.

Equal sets are one class from the start. Each class is first compared with
the one partner that shares most parts with it; then every pair that shares a
part and lies in two components is, so that components are those of all links
although groups of copies are never expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import U64, mix

WORDS = 5
#: Sizes from one bound to the next are a band.
BANDS = np.unique(np.ceil(1.3 ** np.arange(0, 80)).astype(np.int64))
#: Least width of a bit sketch.
SKETCH_BITS = 512
#: Members of one side of a block when untested pairs of a part are compared.
BLOCK = 1000

_PLACE = mix(np.arange(1, 65, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def shingle_sets(chunk: C.Chunk, words: int = WORDS):
    """Distinct shingle hashes of each document, sorted, with document offsets."""
    ws, we = C.word_spans(chunk.buf, chunk.off)
    h = C.span_hashes(chunk.buf, ws, we, lower=True)
    w_off = np.searchsorted(ws, chunk.off)
    count = np.diff(w_off)
    n = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    off = C.offsets(n)
    values = np.zeros(off[-1], U64)
    long = np.flatnonzero(count >= words)
    if len(long):
        rolled = np.zeros(len(h) - words + 1, U64)
        for j in range(words):
            rolled += h[j:len(h) - words + 1 + j] * _PLACE[j]
        source = np.repeat(w_off[:-1][long] - off[:-1][long], n[long])
        target = np.concatenate([np.arange(a, b) for a, b in zip(off[:-1][long], off[1:][long])])
        values[target] = rolled[target + source]
    for d in np.flatnonzero((count > 0) & (count < words)):
        part = h[w_off[d]:w_off[d + 1]]
        values[off[d]] = (part * _PLACE[:len(part)]).sum(dtype=U64) + U64(len(part))
    values = mix(values)
    keep = C.sort_within(values, off)
    sizes = C.segment_counts(keep, off)
    return values[keep], C.offsets(sizes)


def parity_bits(sets: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Parity sketch per set: each shingle flips one bit. The width is a power of two from the set's size on."""
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        width = max(SKETCH_BITS, 1 << max(b - a - 1, 1).bit_length())
        bits = np.bincount((sets[a:b] & U64(width - 1)).astype(np.int64), minlength=width) & 1
        out.append(np.packbits(bits.astype(np.uint8)).tobytes())
    return out


def fold(sketch: bytes, n_bytes: int) -> np.ndarray:
    """The sketch at a smaller width: bits that share their low position are added modulo 2."""
    x = np.frombuffer(sketch, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, n_bytes), axis=0) if len(x) > n_bytes else x


def band_of(size: int) -> int:
    return int(np.searchsorted(BANDS, size, side="right"))


def difference_bound(band: int, percent: int) -> int:
    """Most shingles by which linked sets of this band (the larger set's) can differ."""
    largest = int(BANDS[band]) - 1
    return (2 * largest * (100 - percent)) // (100 + percent)


def part_keys(values: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Keys of the sketch's parts that hold at least m shingles, for the largest m that keeps enough parts.

    Enough are more than the bound: one of them is then alike in any linked
    set. It holds as many shingles there, so the linked set sends it too if
    its own m is no larger, and if it is, the same holds the other way round.
    Parts with many shingles are rarely alike by chance.
    """
    bound = difference_bound(band, percent)
    parts = bound + 2 + -(-(bound + 1) // 4)
    part = ((values >> U64(32)) * U64(parts)) >> U64(32)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    words = np.bitwise_xor.reduceat(mix(values), starts)
    where = part[starts]
    if len(starts) <= bound:
        empty = np.setdiff1d(np.arange(parts, dtype=U64), where)
        where, words = np.r_[where, empty], np.r_[words, np.zeros(len(empty), U64)]
    else:
        held = np.diff(np.r_[starts, len(values)])
        m = np.partition(held, len(held) - 1 - bound)[len(held) - 1 - bound]
        where, words = where[held >= m], words[held >= m]
    return mix(words + (where * U64(64) + U64(band)) * U64(0x9E3779B97F4A7C15))


def set_table(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, n_shingles, fp1, fp2, sketch) per document."""
    def run(batches):
        for ch in C.chunks(batches, "_text"):
            u, off = shingle_sets(ch, words)
            fp1 = C.reduce_segments(np.add, mix(u ^ U64(0x1234567)), off, U64(0))
            fp2 = C.reduce_segments(np.bitwise_xor, mix(u + U64(0x89ABCDEF)), off, U64(0))
            sk = parity_bits(u, off)
            yield pa.RecordBatch.from_arrays(
                [ch.arrow("_id"), pa.array(np.diff(off)), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)),
                 pa.array(sk, pa.binary())],
                ["id", "n_shingles", "fp1", "fp2", "sketch"])
    return _id_text(docs, id_col, text_col).mapInArrow(
        C.tidy(run), "id long, n_shingles long, fp1 long, fp2 long, sketch binary")


def _id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("_id"), C.text_column(docs, text_col).alias("_text"))


def shared_parts(docs: DataFrame, id_col: str, text_col: str, percent: int, n_buckets: int,
                 words: int = WORDS) -> DataFrame:
    """(key, id): parts of sketches that more than one document has."""
    def emit(batches):
        seen: set[int] = set()  # equal sets of this task send their parts once
        for ch in C.chunks(batches, "_text"):
            u, off = shingle_sets(ch, words)
            fp = C.reduce_segments(np.add, mix(u ^ U64(0x1234567)), off, U64(0)).tolist()
            ids = ch.column("_id")
            keys, owner = [], []
            for d, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                if a == b or fp[d] in seen:
                    continue
                seen.add(fp[d])
                # a pair is sought in the band of its larger set
                for at in range(band_of(b - a), band_of((b - a) * 100 // percent) + 1):
                    if difference_bound(at, percent):  # else only equal sets link
                        k = part_keys(u[a:b], at, percent)
                        keys.append(k)
                        owner.append(np.full(len(k), ids[d], np.int64))
            if len(seen) > 500_000:
                seen.clear()
            if keys:
                yield np.concatenate(keys), [np.concatenate(owner)]
    rows = _id_text(docs, id_col, text_col).where("_id IS NOT NULL")
    return C.shared_keys(rows, emit, {"id": "long"}, n_buckets)


def candidate_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, shingles) of the wanted ids; texts travel compressed, sets with 40 bits a shingle."""
    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            blobs = [z.compress(t.as_buffer()) if t.is_valid else None for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["id", "squeezed"])

    def to_sets(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                text = pa.array([z.decompress(b) if b is not None else None for b in part.column(1).to_pylist()], pa.large_binary())
                for ch in C.chunks([pa.RecordBatch.from_arrays([part.column(0), text], ["_id", "_text"])], "_text"):
                    u, off = shingle_sets(ch, words)
                    small = (u >> U64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                    yield pa.RecordBatch.from_arrays(
                        [ch.arrow("_id"), pa.array([small[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())],
                        ["id", "shingles"])

    source = _id_text(docs, id_col, text_col).where("_id IS NOT NULL").mapInArrow(C.tidy(squeeze), "id long, squeezed binary")
    return (source.join(wanted, "id", "left_semi").dropDuplicates(["id"])
            .mapInArrow(C.tidy(to_sets), "id long, shingles binary"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    def decode(blob: bytes) -> np.ndarray:
        out = np.zeros((len(blob) // 5, 8), np.uint8)
        out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
        return out.view("<u8").reshape(-1)

    def verify(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            keep, last, held = np.zeros(len(a), bool), None, None
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                if a[i] != last:
                    last, held = a[i], decode(x.as_py())
                other = decode(y.as_py())
                both = np.concatenate([held, other])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * inter >= percent * (len(both) - inter)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return (pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a").select("a", "b", "sa", "sb")
            .mapInArrow(C.tidy(verify), "a long, b long"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       percent: int = 80, words: int = WORDS) -> DataFrame:
    """Components of the documents whose shingle sets reach ``percent`` Jaccard.

    Returns (doc_id, n_shingles, class_id, component_id), one row per input
    row: ``class_id`` is the smallest id with the same set, ``component_id``
    the smallest id reachable by links. A text without words (or null) has an
    empty set and links with nothing. A row whose id is null has no partners
    and null ids. Rows that repeat an id share its component. Texts are read
    whole; other columns are ignored.
    """
    n_buckets = C.bucket_count(C.text_bytes(docs, text_col))
    sets = C.write_table(set_table(docs, id_col, text_col, words), "shingles")
    classes = (sets.where("n_shingles > 0 AND id IS NOT NULL").groupBy("fp1", "fp2", "n_shingles")
               .agg(F.min("id").alias("class_id"), F.count("*").alias("copies")))
    several = classes.where("copies > 1").drop("copies")
    member = C.write_table(
        sets.drop("sketch").join(several, ["fp1", "fp2", "n_shingles"], "left")
        .select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id")), "member")
    to_class = member.where("id <> class_id").select("id", "class_id").distinct()
    about = (sets.where("id IS NOT NULL").select("id", F.col("n_shingles").cast("int").alias("n"), "sketch")
             .dropDuplicates(["id"]))

    parts = (shared_parts(docs, id_col, text_col, percent, n_buckets, words).join(to_class, "id", "left")
             .select("key", F.coalesce("class_id", "id").alias("id")).distinct())
    parts = C.write_table(parts.join(parts.groupBy("key").count().where("count > 1").drop("count"), "key"), "parts")

    first = parts.groupBy("key").agg(F.min("id").alias("a"))
    star = (parts.join(first, "key").where("a < id").groupBy("a", F.col("id").alias("b")).count()
            .groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", "b"))
    star = C.write_table(_can_link(star, about, percent), "pairs")
    shingles = C.write_table(candidate_sets(parts.select("id").distinct(), docs, id_col, text_col, words), "sets")
    links = C.write_table(linked(star, shingles, percent), "links")
    labels = C.connected_components(links)

    # what the first links have not joined: compare every pair of unlike components that shares a part
    known = parts.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    torn = (known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                     F.count("*").alias("members")).where("lo < hi"))
    more = _bounded_pairs(known.join(torn.select("key", "members"), "key").join(about, "id"), percent)
    more = C.write_table(more.distinct().join(star, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links = links.unionByName(linked(more, shingles, percent))
        labels = C.connected_components(links)
    return (member.join(labels.toDF("class_id", "component"), "class_id", "left")
            .select(F.col("id").alias("doc_id"), "n_shingles", "class_id",
                    F.coalesce("component", "class_id", "id").alias("component_id")))


def _can_link(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and parity sketches do not rule out."""
    def run(batches):
        for batch in batches:
            n1, n2 = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            keep = [bool(_within(x, y, *_same_width([p, q]), percent)) for x, y, p, q in
                    zip(n1, n2, batch.column(3).to_pylist(), batch.column(5).to_pylist())]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
    return (pairs.join(about.toDF("a", "n1", "s1"), "a").join(about.toDF("b", "n2", "s2"), "b")
            .select("a", "b", "n1", "s1", "n2", "s2").mapInArrow(C.tidy(run), "a long, b long"))


def _same_width(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of 64-bit words, folded to the least width among them."""
    least = min(map(len, sketches))
    return np.stack([fold(s, least) for s in sketches]).view(U64)


def _within(n1, n2, s1, s2, percent: int):
    """Whether sizes and sketches (the Hamming distance is at most the difference) allow a link."""
    apart = np.bitwise_count(s1 ^ s2).sum(axis=-1, dtype=np.int64)
    return ((100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))
            & (apart * (100 + percent) <= (n1 + n2) * (100 - percent)))


def _bounded_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of unlike components within a part that sizes and bit sketches let pass.

    A part with many members is dealt out as pairs of blocks, so that no task
    holds more than two blocks of it.
    """
    side = F.ceil(F.col("members") / BLOCK).cast("long")
    dealt = (rows.withColumn("s", side).withColumn("x", F.pmod(F.xxhash64("id"), F.col("s")))
             .withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
             .select("key", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"),
                     "id", "n", "component", "sketch")
             .repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi"))

    def compare(batches):
        for _, _, _, ids, n, comp, sketch in C.sorted_groups(batches, 3):
            if (comp == comp[0]).all():
                continue
            n, sk = n.astype(np.int64), _same_width(sketch)  # a part's sets are of near sizes
            for i in range(len(ids) - 1):
                ok = _within(n[i], n[i + 1:], sk[i], sk[i + 1:], percent) & (comp[i + 1:] != comp[i])
                if ok.any():
                    other = ids[i + 1:][ok]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, ids[i])), pa.array(np.maximum(other, ids[i]))],
                                                     ["a", "b"])
    return dealt.mapInArrow(C.tidy(compare), "a long, b long")
