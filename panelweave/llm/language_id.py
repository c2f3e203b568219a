"""Language identification of words and documents by a linear-chain conditional random field.

Every word (a run of letters) of a text gets a language. Its emission scores add up learned weights of hashed
character n-grams with word marks (so that prefixes and suffixes are features of their own) and of the word
itself when it is in the lexicon; learned transitions tie neighbouring words together. Forward-backward gives
each word's marginal over the languages; the language of the highest mean marginal is the document's.

A word may also be of no learned language: each language has a chain of letters (order two, Witten-Bell), and the
unknown state draws letters one by one as often as they occur in the sample. The chain's posterior against that
state, weighted by the word's marginals, is how far the word is known; a document's score is the mean over its
letters. So text that switches between known languages scores high, gibberish and texts in an unlearned
language score low, and the number of languages does not matter.

The model is fitted on the driver on a bounded sample: at most ``SAMPLE`` labelled documents per language, those
with the smallest hash of their id. Documents of at most ``SAMPLE_CHARS`` characters come first; where a language
has too few, longer ones give one block of whole lines of at most that length, at a hashed place. Every second training sequence
is spliced from lines of documents in different languages, so the transitions learn that text may switch. The
lexicon is the sample's words that occur at least ``LEXICON_LEAST`` times. Prediction runs over every whole
text inside the tasks: emissions are computed once per distinct word of a batch, and the recursions go over
blocks of words of all texts at once, so a very long text takes no longer than the same words in short ones.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from panelweave.llm.common import broadcast_object, in_arrow, received, texts

#: Bounds of the training sample: documents per language, characters per document.
SAMPLE, SAMPLE_CHARS = 60, 20_000
#: Languages learned at most, those with the most labelled documents (ties by name); the model has a column for each.
LANGUAGES = 256
LEXICON_LEAST = 3
GRAMS = (2, 3, 4)
_BITS = 16
_BLOCK = 32
_ROUNDS, _RATE, _DECAY = 20, 0.15, 1e-4
_SLICE_BYTES = 3 << 19
#: Documents below this score count as of unknown language in ``known_language``: most of their letters are unknown.
LEAST_SCORE = 0.5
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long"
_MULTIPLIER, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


@dataclass
class Chains:
    """Letter chains of all languages: log ratios to the unknown state, by sorted codes of letters.

    ``triples`` and ``pairs`` hold the ratios of a letter after two letters and after one; ``contexts`` and
    ``letters`` what is added when the letter was not seen after those two letters, or after that one.
    """

    triples: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]
    letters: tuple[np.ndarray, np.ndarray]


@dataclass
class Model:
    """Languages in order, emission weights by feature, lexicon (sorted word hashes), log transitions, letter chains."""

    languages: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    lexical: np.ndarray
    transitions: np.ndarray
    chains: Chains


@dataclass
class Words:
    """Distinct words of a batch: for each n the feature and the word of every n-gram, and the word hashes."""

    features: list[tuple[np.ndarray, np.ndarray]]
    hashes: np.ndarray


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word number of every word in a row, and the first word of each text (with the end)."""
    lists = pc.split_pattern_regex(pc.utf8_lower(column), r"\PL+")
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    some = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    coded = flat.filter(some).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), before[offsets]


def word_features(words: pa.Array) -> Words:
    """Hashed n-grams of all words, computed as one array of code points."""
    strings = words.to_pylist()
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in strings).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in strings), dtype=np.int64, count=len(strings))
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(strings)), sizes)
    features = []
    m = np.uint64(_MULTIPLIER)
    for n in GRAMS:
        if len(points) < n:
            features.append((np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
            continue
        h = np.full(len(points) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * m
            h ^= h >> np.uint64(32)
        inside = np.arange(len(h)) + n <= ends[of[: len(h)]]
        features.append(((h >> np.uint64(64 - _BITS)).astype(np.int64)[inside], of[: len(h)][inside]))
    place = np.arange(len(points)) - np.repeat(ends - sizes, sizes)
    mixed = (points + np.uint64(1)) * m
    mixed = (mixed ^ (mixed >> np.uint64(29))) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(0xBF58476D1CE4E5B9))
    hashes = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), ends - sizes) if len(strings) else np.zeros(0, dtype=np.uint64)
    return Words(features, hashes)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every letter of the words and their end marks, the word it is in, and codes of the one and two letters before it."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(place > 0)
    one = points[at - 1]
    return points[at], np.repeat(np.arange(len(words)), sizes)[at], one, np.where(place[at] > 1, points[at - 2], 0) << 21 | one


def fit_chains(samples: list[list[str]]) -> Chains:
    """Letter chains of the texts of each language."""
    split = [split_words(pa.array(found, pa.string())) for found in samples]
    words = [w for distinct, _, _ in split for w in distinct.to_pylist()]
    times = np.concatenate([np.zeros(0, dtype=np.int64)] + [np.bincount(index, minlength=len(distinct)) for distinct, index, _ in split])
    language = np.repeat(np.arange(len(samples)), [len(distinct) for distinct, _, _ in split])
    letter, of, one, two = _letters(words)
    times, language, n = times[of].astype(float), language[of], len(samples)

    def counted(codes: np.ndarray, weigh: np.ndarray, of_language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, index = np.unique(codes, return_inverse=True)
        out = np.zeros((len(names), n))
        np.add.at(out, (index, of_language), weigh)
        return names, out

    def step(before: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        codes, seen = counted(before << 21 | letter, times, language)
        some = np.nonzero(seen)
        contexts, kinds = counted(codes[some[0]] >> 21, np.ones(len(some[0])), some[1])
        whole = counted(before, times, language)[1]
        own = np.searchsorted(contexts, codes >> 21)
        with np.errstate(divide="ignore", invalid="ignore"):
            less = np.where(whole > 0, kinds / (whole + kinds), 1.0)
            more = np.where(whole[own] > 0, seen / (whole + kinds)[own], 0.0) / share[np.searchsorted(alphabet, codes & (1 << 21) - 1)][:, None]
        return codes, more + less[own] * lower(codes), contexts, less

    alphabet, place = np.unique(letter, return_inverse=True)
    share = np.bincount(place, weights=times, minlength=len(alphabet))
    share = share / max(share.sum(), 1.0)
    pairs, after_one, letters, fewer = step(one, lambda codes: 1.0)
    triples, after_two, contexts, less = step(two, lambda codes: after_one[np.searchsorted(pairs, codes & (1 << 42) - 1)])
    return Chains((triples, np.log(after_two)), (contexts, np.log(less)), (pairs, np.log(after_one)), (letters, np.log(fewer)))


def known(chains: Chains, words: pa.Array) -> np.ndarray:
    """Posterior of every word and language against the unknown state, both equally likely before."""
    strings = words.to_pylist()
    letter, of, one, two = _letters(strings)
    n = chains.letters[1].shape[1]
    out = np.zeros((len(strings), n))
    if not len(chains.letters[0]):
        return out

    def add(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray, where: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(table[0], codes), len(table[0]) - 1)
        hit = table[0][at] == codes
        for k in range(n):
            out[:, k] += np.bincount(where[hit], weights=table[1][at[hit], k], minlength=len(strings))
        return ~hit

    rest = add(chains.triples, two << 21 | letter, of)
    letter, of, one, two = letter[rest], of[rest], one[rest], two[rest]
    add(chains.contexts, two, of)
    rest = add(chains.pairs, one << 21 | letter, of)
    add(chains.letters, one[rest], of[rest])
    return 1.0 / (1.0 + np.exp(-np.clip(out, -500, 500)))


def _in_lexicon(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are in the lexicon, and where."""
    if not len(model.lexicon):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
    found = np.flatnonzero(model.lexicon[at] == hashes)
    return found, at[found]


def emissions(model: Model, words: Words) -> np.ndarray:
    """Log scores of every word and language."""
    n = len(words.hashes)
    out = np.zeros((n, len(model.languages)))
    for feature, of in words.features:
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(of, weights=model.grams[feature, k], minlength=n)
    found, at = _in_lexicon(model, words.hashes)
    out[found] += model.lexical[at]
    return out


def forward_backward(
    scores: np.ndarray, offsets: np.ndarray, transitions: np.ndarray, learning: bool = False
) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Marginals of every word; when ``learning`` also forward values before and scaled scores times backward values after it.

    Sequences are cut into blocks. The transfer matrix of every block comes first, for all blocks at once; the
    values at block borders follow by a scan over a sequence's blocks, and the words inside from those.
    """
    total, n = scores.shape
    lengths = np.diff(offsets)
    blocks = -(-lengths // _BLOCK)
    first = np.cumsum(blocks) - blocks
    count = int(blocks.sum())
    step = np.exp(transitions)
    place = np.arange(total) - np.repeat(offsets[:-1], lengths)
    at = place % _BLOCK, slice(None), np.repeat(first, lengths) + place // _BLOCK
    x = np.ones((_BLOCK, n, count))
    x[at] = np.exp(scores - scores.max(axis=1, keepdims=True))
    real = np.zeros((_BLOCK, count), dtype=bool)
    real[at[0], at[2]] = True
    matrix = np.zeros((n, n, count))
    matrix[range(n), range(n)] = 1.0
    for s in range(_BLOCK):
        moved = np.matmul(step.T, matrix)
        moved *= x[s]
        if s % 8 == 7:
            moved /= moved.max(axis=(0, 1))
        matrix = moved if real[s].all() else np.where(real[s], moved, matrix)
    before, after = np.full((n, count), 1.0 / n), np.ones((n, count))
    order = np.argsort(-blocks, kind="stable")
    most = int(blocks.max(initial=0))
    longer = [order[: np.searchsorted(-blocks[order], -k, side="left")] for k in range(1, most + 1)]  # more than k blocks
    for k in range(most - 1):
        b = first[longer[k]] + k
        v = np.einsum("ic,ikc->kc", before[:, b], matrix[:, :, b])
        before[:, b + 1] = v / v.sum(axis=0)
    for k in range(most - 2, -1, -1):
        b = first[longer[k]] + k
        v = np.einsum("ikc,kc->ic", matrix[:, :, b + 1], after[:, b + 1])
        after[:, b] = v / v.max(axis=0)
    forward, ahead = np.empty_like(x), np.empty_like(x)
    previous = np.empty_like(x) if learning else None
    a = before
    for s in range(_BLOCK):
        if learning:
            previous[s] = a
        a = (step.T @ a) * x[s]
        a /= a.sum(axis=0)
        forward[s] = a
    b = after
    for s in range(_BLOCK - 1, -1, -1):
        ahead[s] = b
        v = step @ (x[s] * b)
        b = np.where(real[s], v / v.max(axis=0), b)
    forward *= ahead
    forward /= forward.sum(axis=1, keepdims=True)
    if not learning:
        return forward[at], None, None
    ahead *= x
    return forward[at], previous[at], ahead[at]


def fit(samples: dict[str, list[str]], rounds: int = _ROUNDS) -> Model:
    """A model from texts by language: gradient ascent (Adam) on the likelihood of the word labels."""
    languages = sorted(samples)
    if not languages:
        return Model([], np.zeros((1 << _BITS, 0)), np.zeros(0, dtype=np.uint64), np.zeros((0, 0)), np.zeros((0, 0)), fit_chains([]))
    rng = random.Random(7)
    sequences: list[list[tuple[str, int]]] = []
    lines = [[line for text in samples[name] for line in text.split("\n") if line.strip()] for name in languages]
    for k, name in enumerate(languages):
        for text in samples[name]:
            sequences.append([(text, k)])
            picked = [(rng.choice(lines[j]), j) for j in (rng.randrange(len(languages)) for _ in range(6)) if lines[j]]
            sequences.append(picked or [(text, k)])
    parts = [part for sequence in sequences for part in sequence]
    distinct, index, starts = split_words(pa.array([t for t, _ in parts], pa.string()))
    counts = np.diff(starts)
    label = np.repeat(np.asarray([k for _, k in parts]), counts)
    sizes = np.asarray([len(s) for s in sequences])
    offsets = starts[np.concatenate([[0], np.cumsum(sizes)])]
    words = word_features(distinct)
    often = np.bincount(index, minlength=len(distinct)) >= LEXICON_LEAST
    n = len(languages)
    model = Model(languages, np.zeros((1 << _BITS, n)), np.unique(words.hashes[often]), np.zeros((0, n)), np.zeros((n, n)), fit_chains([samples[name] for name in languages]))
    model.lexical = np.zeros((len(model.lexicon), n))
    if not len(index) or n < 2:
        return model
    found, at = _in_lexicon(model, words.hashes)
    truth = np.eye(n)[label]
    inner = np.ones(len(index), dtype=bool)
    inner[offsets[:-1][np.diff(offsets) > 0]] = False
    pairs = np.zeros((n, n))
    np.add.at(pairs, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1.0)
    weights = [model.grams, model.lexical, model.transitions]
    slow, fast = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, rounds + 1):
        scores = emissions(model, words)[index]
        marginals, previous, ahead = forward_backward(scores, offsets, model.transitions, learning=True)
        error = truth - marginals
        of_word = np.stack([np.bincount(index, weights=error[:, k], minlength=len(distinct)) for k in range(n)], axis=1)
        grams = np.zeros_like(model.grams)
        for feature, of in words.features:
            for k in range(n):
                grams[:, k] += np.bincount(feature, weights=of_word[of, k], minlength=1 << _BITS)
        lexical = np.zeros_like(model.lexical)
        np.add.at(lexical, at, of_word[found])
        step = np.exp(model.transitions)
        scale = 1.0 / ((previous[inner] @ step) * ahead[inner]).sum(axis=1, keepdims=True)
        expected = (previous[inner] * scale).T @ ahead[inner] * step
        for i, g in enumerate((grams, lexical, pairs - expected)):
            g = g / len(index) - _DECAY * weights[i] / 100
            slow[i] = 0.9 * slow[i] + 0.1 * g
            fast[i] = 0.99 * fast[i] + 0.01 * g * g
            weights[i] += _RATE * (slow[i] / (1 - 0.9**t)) / (np.sqrt(fast[i] / (1 - 0.99**t)) + 1e-7)
    return model


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _block_of_lines() -> F.Column:
    """Whole lines of a long text inside ``SAMPLE_CHARS`` characters at a hashed place; whole words where lines are too long."""
    start = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.length("text") - SAMPLE_CHARS + 1).cast("int") + 1
    window = F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS))

    def whole(mark: str) -> F.Column:
        parts = F.split(window, mark)
        return F.concat_ws(mark, F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))))

    lines, words = whole("\n"), whole(" ")
    return F.when(F.length(lines) >= SAMPLE_CHARS // 2, lines).when(F.length(words) > 0, words).otherwise(window)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents that are not held out, within the bounds of the sample."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out())
    rows = rows.withColumn("long", F.length("text") > SAMPLE_CHARS)
    labels = rows.groupBy("lang").agg(F.count("*").alias("all"), F.count_if(~F.col("long")).alias("short")).orderBy(F.desc("all"), "lang")
    counts = {r["lang"]: (r["short"], r["all"] - r["short"]) for r in labels.limit(LANGUAGES).collect()}
    if not counts:
        return fit({})

    def share(of: dict[str, float]) -> F.Column:
        return F.element_at(F.create_map(*[F.lit(x) for lang, part in of.items() for x in (lang, part)]), F.col("lang"))

    short = share({lang: min(1.0, 1.5 * sample / max(n, 1)) for lang, (n, _) in counts.items()})
    # as many of the short documents as were counted all come, so the long ones only have to fill what they leave
    longer = share({lang: min(1.0, 1.5 * (sample - n) / m) if n < sample and m else 0.0 for lang, (n, m) in counts.items()})
    place = (F.xxhash64("doc_id", F.lit("sample")) / F.lit(2.0**64)) + 0.5
    picked = rows.filter(F.col("lang").isin(list(counts))).withColumn("place", place).filter(F.col("place") <= F.when(F.col("long"), longer).otherwise(short))
    picked = picked.withColumn("text", F.when(F.col("long"), _block_of_lines()).otherwise(F.col("text")))
    samples: dict[str, list[str]] = {lang: [] for lang in counts}
    order = sorted(picked.select("lang", "long", "place", "doc_id", "text").collect(), key=lambda r: (r["long"], r["place"], r["doc_id"], r["text"]))
    for r in order:
        if len(samples[r["lang"]]) < sample:
            samples[r["lang"]].append(r["text"])
    return fit({lang: found for lang, found in samples.items() if found})


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > _SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def label_batch(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all words of a batch of texts, and the first word of each text (with the end)."""
    return _labels(model, *split_words(column))


def _labels(model: Model, distinct: pa.Array, index: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scores = emissions(model, word_features(distinct))[index]
    if not len(index):
        return np.zeros((0, len(model.languages))), starts
    some = np.flatnonzero(np.diff(starts) > 0)
    return forward_backward(scores, np.append(starts[some], starts[-1]), model.transitions)[0], starts


def _judged(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, best language (its number, one past the last for none) and score of each text."""
    if not model.languages:
        return np.zeros(len(column), dtype=np.int64), np.zeros(len(column), dtype=np.int64), np.zeros(len(column))
    distinct, index, starts = split_words(column)
    marginals, _ = _labels(model, distinct, index, starts)
    counts = np.diff(starts)
    best, score = np.full(len(counts), len(model.languages)), np.zeros(len(counts))
    some = np.flatnonzero(counts > 0)
    if len(some):
        first = starts[:-1][some]
        best[some] = (np.add.reduceat(marginals, first, axis=0) / counts[some, None]).argmax(axis=1)
        letters = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)[index].astype(float)
        sure = (marginals * known(model.chains, distinct)[index]).sum(axis=1)
        score[some] = np.clip(np.add.reduceat(sure * letters, first) / np.add.reduceat(letters, first), 0.0, 1.0)
    return counts, best, score


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_words.

    ``score`` is the share of the text that is of a learned language, of whichever it is.
    ``held_out`` is crc32(doc_id as text) mod 3 = 1; a row without an id is not held out and not learned from.
    A text that is null or has no letter is ``und`` with score 0, as is every text when nothing could be
    learned. Of equal means the first language by name wins. Repeated rows repeat; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    learned = broadcast_object(spark, model if model is not None else train(docs))  # 2**16 rows and the sample's lexicon
    kind = spark.createDataFrame([], SCHEMA).schema
    rows = texts(docs).withColumn("held_out", _held_out())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own = to_arrow_schema(kind), received(learned)
        names = np.asarray([*own.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for part in _slices(batch):
                counts, best, score = _judged(own, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(counts, pa.int64())],
                    schema=out,
                )

    return in_arrow(rows.select("doc_id", "text", "held_out"), run, kind)


def runs_of_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The word labels of code-switched text: doc_id and runs of words (first, words, lang) of one language."""
    spark = docs.sparkSession
    learned = broadcast_object(spark, model if model is not None else train(docs))
    kind = spark.createDataFrame([], "doc_id long, runs array<struct<first:long,words:long,lang:string>>").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own = to_arrow_schema(kind), received(learned)
        for batch in batches:
            for part in _slices(batch):
                marginals, starts = label_batch(own, part.column("text")) if own.languages else (np.zeros((0, 1)), np.zeros(part.num_rows + 1, dtype=np.int64))
                label = marginals.argmax(axis=1)
                found = []
                for low, high in zip(starts[:-1], starts[1:], strict=True):
                    cut = low + np.concatenate([[0], np.flatnonzero(np.diff(label[low:high])) + 1, [high - low]]) if high > low else np.asarray([low])
                    found.append([{"first": int(a - low), "words": int(b - a), "lang": own.languages[label[a]]} for a, b in zip(cut[:-1], cut[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, out.field("runs").type)], schema=out)

    return in_arrow(texts(docs), run, kind)


def known_language(docs: DataFrame, least_score: float = LEAST_SCORE, model: Model | None = None) -> DataFrame:
    """The documents whose language is known with at least ``least_score``, with all their columns.

    Texts without a letter, null texts, gibberish and texts in unlearned languages go. The rows are filtered in the tasks that read them.
    """
    learned = broadcast_object(docs.sparkSession, model if model is not None else train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(learned)
        for batch in batches:
            for part in _slices(batch):
                counts, best, score = _judged(own, pc.fill_null(part.column("text"), ""))
                yield part.filter(pa.array((best < len(own.languages)) & (score >= least_score)))

    return in_arrow(docs, run, docs.schema)
