"""Operator 11: phrases of two to five words that keep together, mined with a sketch and automata.

Counts of all word sequences would be several times the corpus. So words are counted exactly first; a sketch of fixed
width then gives an upper bound for each phrase of common words; phrases whose bound (and whose parts' bounds) reach the
threshold are candidates. One scan counts all their occurrences, overlapping ones too, by a 64-bit hash of language and
phrase, however many candidates there are. All that is counted is listed by its words as well, so that hashes which several
candidates share are known: these candidates are compiled into Aho-Corasick automata, guarded by a space at both ends, and
counted by their words. So sums are exact, and thresholds are applied to them alone: a narrow sketch costs time and no row.

What tasks hold does not grow with the corpus: the sketch has BUCKETS counters, broadcast as bits (32 MB), counters of hashes
leave a task by HELD places, and an automaton has AUTOMATON bytes of candidates.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bitmaps import COUNTERS, bit, bitmap, counter_rows, hash_rows, hash_sums, merged
from .common import chunks, gathered, mix64, offsets, stored

#: Counters of the sketch, as a power of two, and bits that tell which words are common.
BUCKETS = 28
WORD_BITS = 24
#: Bits of the hash that stands for a phrase while it is counted.
HASHED = 64
#: Places of phrases that a task sketches or counts before it lets the counters out.
HELD = 1 << 22
#: Numbers of an automaton's phrases whose counters one row spans, as a power of two.
NUMBERS = 12
#: Bytes of candidates in one automaton.
AUTOMATON = 4 << 20
#: One text in so many is read first for candidates, and bytes of what it has that other tasks hold.
FIRST = 32
KNOWN = 4 << 20
SPAN = 1 << 20
LONGEST = 5
#: Parts into which a language's phrases are dealt, so that a common language isn't one task.
SALTS = 64
#: Distinct rows that a task keeps before it lets them out.
MEMO = 400_000

#: A-Z become small letters, all ends of pieces a full stop (the only one left), tabs spaces.
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(46 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: list[str]) -> list[bytes]:
    """Words in order; a full stop stands where a piece ends."""
    return b".".join([t.encode() for t in texts]).translate(TABLE).replace(b".", b" . ").split()


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language, about SPAN characters at a time."""
    for batch in batches:
        groups = defaultdict(list)
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            if text:
                groups[lang].append(text)
        for lang, texts in groups.items():
            for a, b in chunks(map(len, texts), SPAN):
                yield lang, texts[a:b]


def _cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words in order, with nothing between them, and where each begins, with the end of the last; a full stop is a word where a piece ends or begins."""
    raw = np.frombuffer(b".".join([b"", *(t.encode() for t in texts)]).translate(TABLE), np.uint8)
    kept = raw != 32
    data = raw[kept]
    first = data == 46
    first[1:] |= first[:-1].copy()
    gaps = np.flatnonzero(~kept)
    behind = gaps - np.arange(len(gaps))
    first[behind[behind < len(data)]] = True
    return data, np.append(np.flatnonzero(first), len(data))


def _hashes(data: np.ndarray, starts: np.ndarray, seed) -> np.ndarray:
    """A hash of each word, by eight bytes at a time; seed is one number or one for each word."""
    size = np.diff(starts)
    lanes = np.ndarray(len(data), np.uint64, np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    h = np.uint64(seed) ^ size.astype(np.uint64) * STEP
    live, at, left = np.flatnonzero(size), starts[:-1][size > 0], size[size > 0]
    while len(live):
        own = lanes[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64))
        h[live] = mix64(h[live] * STEP + own)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def _numbered(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, and the distinct words by number."""
    words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    _, at, text = words.dictionary.buffers()
    at, text = np.frombuffer(at, np.int64, len(words.dictionary) + 1).tolist(), text.to_pybytes()
    return words.indices.to_numpy().astype(np.int64), [text[i:j] for i, j in zip(at, at[1:], strict=False)]


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang)


def _places_of(lang: str, data: np.ndarray, starts: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and which are common ones; no full stop is."""
    h = _hashes(data, starts, _seed(lang))
    return h, bit(common, (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)) & (data[starts[:-1]] != 46)


def _levels(h: np.ndarray, common: np.ndarray, heavy: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """n, first words, hashes and sketch buckets of all runs of n common words, for n from 2; only runs whose bucket, and whose parts' buckets, are set in `heavy`, if given."""
    first, value = np.flatnonzero(common), h[common]
    padded, hashes = np.append(common, np.zeros(LONGEST, bool)), np.append(h, np.zeros(LONGEST, np.uint64))
    kept = np.ones(len(h) + 1, bool)
    for n in range(2, LONGEST + 1):
        keep = padded[first + n - 1] & kept[first + 1]
        first, value = first[keep], value[keep]
        value = mix64(value * STEP + hashes[first + n - 1])
        buckets = (value >> np.uint64(64 - BUCKETS)).astype(np.int64)
        if heavy is not None:
            ok = bit(heavy, buckets)
            first, value, buckets = first[ok], value[ok], buckets[ok]
            kept = np.zeros(len(h) + 1, bool)
            kept[first] = True  # the phrases without their last word go on as first, those without their first word by this
        yield n, first, value, buckets


def _hashed(value: np.ndarray) -> np.ndarray:
    """The hash that a phrase is counted by."""
    return value >> np.uint64(64 - HASHED) << np.uint64(64 - HASHED)


def _words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(Counter)

        def out():
            for lang, counter in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counter)), pa.array(list(counter), pa.binary()).cast(pa.string()), pa.array(list(counter.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for lang, texts in _by_language(batches):
            codes, distinct = _numbered(*_cut(texts))
            counter = held[lang]
            counter.update(dict(zip(distinct, np.bincount(codes).tolist(), strict=True)))
            del counter[b"."]
            if sum(map(len, held.values())) > MEMO:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _common_words(words: DataFrame, least: int) -> np.ndarray:
    """Bits of the words that occur `least` times or more; a bit may stand for other words too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode() for w in batch["word"].to_pylist()]
            h = _hashes(np.frombuffer(b"".join(words), np.uint8), offsets([*map(len, words)]), np.array([*map(_seed, batch["lang"].to_pylist())], np.uint64))
            yield counter_rows((h >> np.uint64(64 - WORD_BITS)).astype(np.int64))

    return bitmap(merged(words.filter(F.col("n") >= least).select("lang", "word").mapInArrow(run, COUNTERS), 1, WORD_BITS), WORD_BITS)


def _sketch(docs: DataFrame, common, least: int) -> np.ndarray:
    """Bits of the buckets that hold `least` places of phrases of common words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for lang, texts in _by_language(batches):
            for _, _, _, buckets in _levels(*_places_of(lang, *_cut(texts), common.value)):
                held.append(buckets)
                total += len(buckets)
            if total > HELD:
                yield counter_rows(np.concatenate(held))
                held, total = [], 0
        if held:
            yield counter_rows(np.concatenate(held))

    return bitmap(merged(docs.mapInArrow(run, COUNTERS), least, BUCKETS), BUCKETS)


def _listed(docs: DataFrame, common, heavy, had) -> DataFrame:
    """(lang, phrase, hash) of all phrases of common words whose bucket, and whose parts' buckets, are heavy, but those of `had`.

    Each task lists its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, seen = {lang: frozenset(p.encode() for p in phrases) for lang, phrases in had.value.items()}, defaultdict(set)
        for lang, texts in _by_language(batches):
            cut = _cut(texts)
            codes, distinct = _numbered(*cut)
            ids, new, hashes = codes, [], []
            for n, first, value, _ in _levels(*_places_of(lang, *cut, common.value), heavy.value):
                if not len(first):
                    break
                _, where, number = np.unique(ids[first] * len(distinct) + codes[first + n - 1], return_index=True, return_inverse=True)  # exact numbers of phrases
                ids = np.zeros(len(codes), np.int64)
                ids[first] = number
                found = (b" ".join([distinct[c] for c in run_]) for run_ in codes[first[where][:, None] + np.arange(n)].tolist())
                for phrase, key in zip(found, _hashed(value[where]).view(np.int64).tolist(), strict=True):
                    if phrase not in seen[lang] and phrase not in given.get(lang, ()):
                        new.append(phrase)
                        hashes.append(key)
            seen[lang].update(new)
            if sum(map(len, seen.values())) > MEMO:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(new), pa.string()), pa.array([p.decode() for p in new], pa.string()), pa.array(hashes, pa.int64())], ["lang", "phrase", "hash"])

    return docs.mapInArrow(run, "lang string, phrase string, hash bigint")


def _candidates(docs: DataFrame, common, heavy) -> DataFrame:
    """(lang, phrase, hash) of all candidates, each listed by few tasks.

    A phrase that occurs often occurs in nearly all tasks, each of which would list it. One text in FIRST is read before, in
    as many times fewer tasks, and what it has is listed no more: a phrase that it lacks is rare and lies in few tasks. Tasks
    hold KNOWN bytes of it at most; what is known beyond is listed anew, which costs rows and no phrase.
    """
    context = docs.sparkSession.sparkContext
    own = docs.filter(F.pmod(F.xxhash64("text"), F.lit(FIRST)) == 0)
    early = stored(_listed(own.repartition(-(-docs.rdd.getNumPartitions() // FIRST)), common, heavy, context.broadcast({})).distinct(), "phrase-candidates")
    size = early.agg(F.sum(F.octet_length("phrase") + 2)).first()[0] or 0
    parts = max(1, -(-size // KNOWN))
    known = early.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == 0).select("lang", "phrase").toPandas()
    given = context.broadcast({lang: rows.tolist() for lang, rows in known.groupby("lang")["phrase"]})
    late = _listed(docs, common, heavy, given).distinct()
    return early.union(late if parts == 1 else late.join(early, ["lang", "phrase"], "left_anti"))


def _sums(docs: DataFrame, common, heavy, least: int) -> DataFrame:
    """(hash, a) of all hashes of candidates whose places are `least` or more; one scan, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for lang, texts in _by_language(batches):
            for _, _, value, _ in _levels(*_places_of(lang, *_cut(texts), common.value), heavy.value):
                held.append(_hashed(value))
                total += len(value)
            if total > HELD:
                yield hash_rows(np.concatenate(held))
                held, total = [], 0
        if held:
            yield hash_rows(np.concatenate(held))

    return hash_sums(docs.mapInArrow(run, COUNTERS), least).withColumnRenamed("n", "a")


def _places(docs: DataFrame, phrases) -> DataFrame:
    """(lang, block, low, n) counters of the broadcast phrases by their numbers, by one automaton in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        names = phrases.value
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, phrase in enumerate(names):
            automaton.add_word(f" {phrase} ", k)
        if not names:
            return
        automaton.make_automaton()
        held, total = defaultdict(list), 0

        def out():
            for lang, hits in held.items():
                rows = counter_rows(np.concatenate(hits), NUMBERS)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * rows.num_rows, pa.string()), *rows.columns], ["lang", *rows.schema.names])
            held.clear()

        for lang, texts in _by_language(batches):
            text = f" {b' '.join(tokens(texts)).decode()} "
            hits = np.fromiter((k for _, k in automaton.iter(text)), np.int64)
            held[lang].append(hits)
            total += len(hits)
            if total > HELD:
                yield from out()
                total = 0
        yield from out()

    return docs.mapInArrow(run, f"lang string, {COUNTERS}")


def _occurrences(docs: DataFrame, phrases) -> DataFrame:
    """(lang, phrase, a) of the broadcast phrases that occur; counters of one block are added up at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, counters = phrases.value, None, np.zeros(1 << NUMBERS, np.int64)

        def out():
            some = np.flatnonzero(counters)
            found = [names[(key[1] << NUMBERS) + k] for k in some.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(counters[some])], ["lang", "phrase", "a"])

        for batch in batches:
            for lang, block, low, n in zip(*(batch[c].to_pylist() for c in ("lang", "block", "low", "n")), strict=True):
                if (lang, block) != key:
                    if key:
                        yield out()
                    key, counters = (lang, block), np.zeros(1 << NUMBERS, np.int64)
                counters[np.frombuffer(low, np.uint16)] += np.frombuffer(n, np.uint32)
        if key:
            yield out()

    return _places(docs, phrases).repartition("lang", "block").sortWithinPartitions("lang", "block").mapInArrow(run, "lang string, phrase string, a bigint")


def _counted(docs: DataFrame, candidates: DataFrame, common, heavy, least: int, automaton: int) -> DataFrame:
    """Exact (lang, phrase, a) of all candidates that occur `least` times or more.

    Candidates are all that the sums hold, so that a hash of one candidate has its count; those that share one are counted apart.
    """
    sums = _sums(docs, common, heavy, least)
    shared = candidates.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    if shared.isEmpty():
        return candidates.join(sums, "hash").select("lang", "phrase", "a")
    alone = candidates.join(shared, "hash", "left_anti").join(sums, "hash").select("lang", "phrase", "a")
    clashing = stored(candidates.join(shared, "hash", "left_semi").select("lang", "phrase"), "phrase-clashes")
    apart = _counted_apart(docs, clashing.select("phrase").distinct(), automaton).filter(F.col("a") >= least)
    return alone.union(apart.join(clashing, ["lang", "phrase"]))


def _counted_apart(docs: DataFrame, candidates: DataFrame, automaton: int) -> DataFrame:
    """Exact (lang, phrase, a) of these phrases by their words, in blocks of about `automaton` bytes of them."""
    context = docs.sparkSession.sparkContext
    size = candidates.agg(F.sum(F.octet_length("phrase") + 2)).first()[0] or 0
    blocks = max(1, -(-size // automaton))
    block = F.pmod(F.xxhash64("phrase"), F.lit(blocks))

    def parts() -> Iterator[DataFrame]:
        for b in range(blocks):
            own = candidates.filter(block == b).toPandas()["phrase"].tolist()
            yield _occurrences(docs, context.broadcast(sorted(own)))

    return gathered(parts(), blocks, "phrase-counts")


def _part(words: Column, start, n) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def mine(docs: DataFrame, least: int = 100, top: int = 2000, automaton: int = AUTOMATON) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's best phrases of 2 to 5 words that occur `least` times or more.

    A-Z are lowered; pieces end at . , ; : ! ? and line ends; words are what spaces and tabs part. a counts all contiguous
    occurrences within pieces, overlapping ones too; l and r those of both parts at the cut with the lowest score, ties to
    the earlier cut; n all words of the language; score is floor(1000 a n / (l r)), computed exactly. A phrase within a
    longer one that occurs as often is dropped. Ranked by score, a (both descending) and phrase (UTF-8 bytes); the first
    `top` of each language are returned.

    A null language is und, and goes together with that name. Null and empty texts have no words. Each repeated row counts.
    Very long texts are read whole. An empty table, or one without common phrases, gives no rows. Other columns, doc_id too,
    are not read.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    words = stored(_words(docs), "phrase-words")
    common = context.broadcast(_common_words(words, least))
    heavy = context.broadcast(_sketch(docs, common, least))
    candidates = stored(_candidates(docs, common, heavy), "phrase-candidates")
    found = stored(_counted(docs, candidates, common, heavy, least, automaton), "phrases")

    own = found.withColumn("w", F.split("phrase", " "))
    size = F.size("w")
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, size).alias("right"))
    parts = words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")).union(found)
    cuts = cuts.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"])
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cuts = cuts.withColumn("salt", salt).join(totals, ["lang", "salt"])
    score = (F.lit(1000).cast("decimal(4,0)") * _wide("a") * _wide("n")).alias("u"), (_wide("l") * _wide("r")).alias("v")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", "n", *score).withColumn("score", F.expr("u div v"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    within = own.filter(size > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), size - 1)).alias("m")).withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
    longer = within.groupBy("lang", _part(F.col("w"), F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))

    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", salt.alias("salt"))
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)  # of SALTS x top rows at most
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
