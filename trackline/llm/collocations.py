"""Collocations: phrases of two to four words that occur far more often together than their parts do.

Word sequences are hashed into partitions. The first pass keeps one Misra-Gries summary per partition: tasks send small
summaries of their own, which are merged under a capacity above the partition's mass divided by the threshold, so the
error stays below the threshold and no frequent sequence is lost. The second pass counts what survived exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from trackline.session import checkpointed

LONGEST = 4
THRESHOLD = 30
LIMIT = 2000
SHARE = 80  # percent of a phrase's occurrences inside a longer one that make it a part of that
SCALE = 2_000_000
BATCH = 2 << 20  # bytes of text counted at once
PART = 4 << 20  # bytes of text per hash partition, some three million sequences
FILTER_BITS = 1 << 29  # bound of the broadcast filter: 64 MB
WORDS = 250_000  # words whose numbers a task remembers between batches
CROWD = 50_000  # rows of one language that a task ranks

# What parts pieces, and how pieces and words are told apart once those are full stops.
STOPS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Vocabulary(dict):
    """Numbers of words in order of appearance, with their hashes. Number 0 is the stop between pieces."""

    def __init__(self) -> None:
        super().__init__({b".": 0})
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return found


def slices(text: bytes, size: int) -> Iterator[bytes]:
    """The text cut behind stops into slices of ``size`` bytes or, where no stop comes, more."""
    at = 0
    while len(text) - at > size:
        stop = text.find(b".", at + size)
        if stop < 0:
            break
        yield text[at : stop + 1]
        at = stop + 1
    yield text[at:]


class Sequences:
    """The words of a batch of texts: ``tokens``, their numbers, the number of each one's language, and hashes."""

    def __init__(self, rows: list[tuple[str, bytes]], vocabulary: Vocabulary):
        self.langs = list(dict.fromkeys(lang for lang, _ in rows))
        code = {lang: i for i, lang in enumerate(self.langs)}
        self.tokens: list[bytes] = []
        lengths = []
        for _, text in rows:
            found = text.replace(b".", b" . ").split()
            found.append(b".")
            self.tokens += found
            lengths.append(len(found))
        self.ids = np.fromiter(map(vocabulary.__getitem__, self.tokens), np.int64, len(self.tokens))
        self.lang = np.repeat(np.array([code[lang] for lang, _ in rows], np.int64), lengths)
        seeds = np.array([xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 1) for lang in self.langs], np.uint64)
        self.first = mixed(np.array(vocabulary.hashes, np.uint64)[self.ids] ^ seeds[self.lang])

    def hashes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per length: the places where such a sequence begins, all in one piece, and the hashes of those."""
        inside, value = self.ids != 0, self.first
        for n in range(1, LONGEST + 1):
            if n > 1:
                inside = inside[:-1] & (self.ids[n - 1 :] != 0)
                value = mixed(value[:-1] * M2 + self.first[n - 1 :] + np.uint64(n))
            at = np.flatnonzero(inside)
            yield n, at, value[at]


def batches(frames: Iterator[pd.DataFrame]) -> Iterator[Sequences]:
    vocabulary, held, size = Vocabulary(), [], 0
    for frame in frames:
        for lang, text in zip(frame["lang"].tolist(), frame["text"].tolist()):
            for part in slices(text.encode("utf-8", "surrogatepass").lower().translate(STOPS), BATCH):
                held.append((lang, part))
                size += len(part)
                if size >= BATCH:
                    yield Sequences(held, vocabulary)
                    held, size = [], 0
                    if len(vocabulary) > WORDS:
                        vocabulary = Vocabulary()
    if held:
        yield Sequences(held, vocabulary)


def placed(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Partition and 32 further bits of each hash, in one number. A collision only adds to an estimate."""
    return hashes >> np.uint64(32 - bits)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


class Summary:
    """A Misra-Gries summary with at most ``capacity`` counters; ``error`` is the most that any count lacks."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = added(np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts)))
        if len(self.keys) > self.capacity:
            beyond = len(self.counts) - self.capacity - 1
            least = int(np.partition(self.counts, beyond)[beyond])  # the largest count without a counter
            stays = self.counts > least
            self.keys, self.counts = self.keys[stays], self.counts[stays] - least
            self.error += least

    def candidates(self, threshold: int) -> np.ndarray:
        return self.keys[self.counts + self.error >= threshold]


def merged(keys: list[np.ndarray], counts: list[np.ndarray], threshold: int) -> Summary:
    """One summary out of many. Its error is at most mass / (capacity + 1), hence below the threshold."""
    mass = sum(int(c.sum(dtype=np.int64)) for c in counts)
    out, some, size = Summary(mass // threshold + 1), 0, 0
    for i, part in enumerate(keys):
        size += len(part)
        if size > 1 << 20 or i == len(keys) - 1:
            out.merge(np.concatenate(keys[some : i + 1]), np.concatenate(counts[some : i + 1]))
            some, size = i + 1, 0
    return out


def summaries(texts: DataFrame, bits: int) -> DataFrame:
    """(part, once, keys, counts): a batch's sequences of one partition, those seen once apart from the others."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches(frames):
            found = np.sort(np.concatenate([placed(h, bits) for _, _, h in batch.hashes()]))
            if not len(found):
                continue
            starts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
            keys, counts = found[starts], np.diff(np.append(starts, len(found)))
            parts = keys >> np.uint64(32)
            edges = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1], [True])))
            keys, rows = keys.astype(np.uint32), []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own, times = keys[a:b], counts[a:b]
                often = times > 1
                rows.append((int(parts[a]), own[~often].tobytes(), own[often].tobytes(), times[often].astype("<u4").tobytes()))
            yield pd.DataFrame(rows, columns=["part", "once", "keys", "counts"])

    return texts.mapInPandas(count, "part long, once binary, keys binary, counts binary")


def survivors(parts: DataFrame, threshold: int) -> DataFrame:
    """(part, keys): the keys of each partition that may have ``threshold`` occurrences."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        for once, some, times in zip(frame["once"], frame["keys"], frame["counts"]):
            single = np.frombuffer(once, "<u4")
            keys.append(np.concatenate((single, np.frombuffer(some, "<u4"))))
            counts.append(np.concatenate((np.ones(len(single), np.uint32), np.frombuffer(times, "<u4"))))
        found = merged(keys, counts, threshold).candidates(threshold)
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "keys": [found.tobytes()]})

    return parts.groupBy("part").applyInPandas(merge, "part long, keys binary")


def probes(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a partition's ``width`` (a power of two) for each 32-bit key."""
    value, mask = mixed(keys.astype(np.uint64) + np.uint64(1)), np.uint64(width - 1)
    return value & mask, (value >> np.uint64(32)) & mask


def filter_of(kept: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """A bit map of the surviving keys, and its bits per partition: 16 per key, but never over ``FILTER_BITS`` in all.

    A denser map lets more sequences through to the exact count, which drops them; it loses none.
    """
    n = kept.agg(F.sum(F.octet_length("keys") / 4)).first()[0] or 0
    width = 8
    while width << bits < min(16 * n, FILTER_BITS):
        width *= 2

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for keys in frame["keys"]:
                marks = np.zeros(width, bool)
                for at in probes(np.frombuffer(keys, "<u4"), width):
                    marks[at] = True
                out.append(np.packbits(marks, bitorder="little").tobytes())
            yield pd.DataFrame({"part": frame["part"], "marks": out})

    found = np.zeros((1 << bits, width // 8), np.uint8)
    # The bit map in pieces: as bounded as the whole.
    for r in kept.mapInPandas(mark, "part long, marks binary").toLocalIterator():
        found[r.part] = np.frombuffer(r.marks, np.uint8)
    return found.reshape(-1), width


def exact_counts(texts: DataFrame, bits: int, kept: DataFrame) -> DataFrame:
    """(lang, words, phrase, f): exact counts of all surviving sequences, and with ``words`` 0 of all words."""
    marks, width = filter_of(kept, bits)
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def survive(hashes: np.ndarray) -> np.ndarray:
        place = placed(hashes, bits)
        base, out = (place >> np.uint64(32)) * np.uint64(width), np.ones(len(place), bool)
        for at in probes(place & np.uint64(0xFFFFFFFF), width):
            at = base + at
            out &= (shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches(frames):
            total = np.bincount(batch.lang[batch.ids != 0], minlength=len(batch.langs))
            yield pd.DataFrame({"lang": batch.langs, "words": 0, "phrase": "", "f": total})
            # Sequences are told apart by their words' numbers, never by hashes: a longer one is the number of all but
            # its last word, among those found so far, and that word.
            number = batch.lang
            alive = np.ones(len(batch.ids), bool)
            for n, at, hashes in batch.hashes():
                # Where a sequence survives, so do its parts.
                at, hashes = (x[alive[at] & (alive[at + 1] if n > 1 else True)] for x in (at, hashes))
                at = at[survive(hashes)]
                if not len(at):
                    break
                _, first, which, f = np.unique(number[at] << 32 | batch.ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
                tokens, heads = batch.tokens, at[first].tolist()
                found = [b" ".join(tokens[i : i + n]).decode("utf-8", "surrogatepass") for i in heads]
                yield pd.DataFrame({"lang": [batch.langs[c] for c in batch.lang[heads].tolist()], "words": n, "phrase": found, "f": f})
                number, alive = np.zeros(len(batch.ids), np.int64), np.zeros(len(batch.ids) + 1, bool)
                number[at], alive[at] = which, True

    return texts.mapInPandas(count, "lang string, words int, phrase string, f long").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def best_of(df: DataFrame, group: str, order: list, key: str, limit: int, out: str) -> DataFrame:
    """The first ``limit`` rows of each group with their rank; no task ranks over ``CROWD`` rows of a group, or so."""
    room = max(CROWD, 20 * limit)
    while True:
        most = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
        if most <= room:
            break
        salt = F.pmod(F.xxhash64(key), F.lit(-(-most // room)))
        near = F.row_number().over(Window.partitionBy(group, salt).orderBy(*order))
        df = checkpointed(df.withColumn(out, near).where(F.col(out) <= limit).drop(out))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")
    return df.withColumn(out, rank).where(F.col(out) <= limit)


def phrases(
    df: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, limit: int = LIMIT, share: int = SHARE,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``limit`` strongest phrases of each language.

    A null text is empty, a null language is ``und``; repeated rows count each time; other columns are not read; an
    empty table gives no rows. ``a``, ``l`` and ``r`` count the phrase and the two parts of its weakest cut, ``n`` the
    language's words. A phrase goes if a longer frequent one holds it and has ``share`` percent of its occurrences.
    Ties are broken by ``a`` and the phrase's bytes, so the result does not depend on partitioning.
    """
    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(20, max(3, (size // PART).bit_length()))
    kept = checkpointed(survivors(summaries(texts, bits), threshold))
    counted = checkpointed(exact_counts(texts, bits, kept).where((F.col("f") >= threshold) | (F.col("words") == 0)))
    known = counted.where("words > 0")
    found = known.where("words > 1").withColumnRenamed("f", "a")

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    side = lambda part, f: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.expr(f"{SCALE} * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    parts = F.split("phrase", " ")
    spans = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(m).alias("size")) for m in range(2, LONGEST) for s in range(1, LONGEST - m + 2)])
    inner = found.where("words > 2").withColumn("span", F.explode(spans)).where("span.size < words AND span.start + span.size - 1 <= words")
    inner = inner.select("lang", F.concat_ws(" ", F.slice(parts, F.col("span.start"), F.col("span.size"))).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    swallowed = F.col("longer").isNotNull() & (wide("longer") * 100 >= wide("a") * share)
    left = weakest.join(longer, ["lang", "phrase"], "left").where(~swallowed)
    left = checkpointed(left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = best_of(left, "lang", order, "phrase", limit, "rank")
    totals = counted.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m AS words, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM pieces, (VALUES (1), (2), (3), (4)) AS sizes(m)),
known AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
found AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM known WHERE words > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r,
    (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM found) AS c
  JOIN known AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN known AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (
  SELECT lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, max(a) AS longer
  FROM found, (VALUES (2), (3)) AS sizes(m), (VALUES (1), (2), (3)) AS starts(s)
  WHERE m < words AND s + m - 1 <= words GROUP BY ALL),
stays AS (
  SELECT k.* FROM weakest AS k LEFT JOIN spans AS p ON p.lang = k.lang AND p.phrase = k.phrase
  WHERE p.longer IS NULL OR 100::HUGEINT * p.longer < 80::HUGEINT * k.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stays) JOIN totals USING (lang)
WHERE rank <= 2000
"""
