"""A toxicity score from a weighted lexicon learned from labels.

Method: a weighted lexicon matched by Aho-Corasick after folding homoglyphs and digit
substitutions, normalised by length, with exception phrases.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import making_room
from .text_arrays import Texts, U, gram_hashes, texts

#: Characters read as the Latin letter they look like. Letters with accents are
#: read without them; digits and signs stand for letters only where they touch one.
HOMOGLYPHS = dict(zip("абвекмнорстухіјѕԁɡһαβεικνορτυχı", "abbekmhopctyxijsdghabeikvoptuxi", strict=True))
DIGITS = str.maketrans("01345789@$!|+", "oieastbgasilt")

_MASKS = re.compile(r"[013-57-9@$!|+]+")
_WORD = re.compile(r"[^\W_]+")


class _Fold(dict):
    """The folded form of a character, for str.translate; found when first met."""

    def __missing__(self, code: int) -> str | None:
        plain = chr(code).lower()
        if unicodedata.combining(plain[0]):
            found = None
        else:
            bare = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c)).lower()
            found = bare if len(bare) == 1 else plain[0]
            found = HOMOGLYPHS.get(found, found)
        self[code] = found
        return found


_FOLD = _Fold()
#: The same for texts of the first 256 characters, as long as the forms are among them too.
_LATIN = bytes(ord(f) if (f := _FOLD[code]) and ord(f) < 256 else code for code in range(256))


def _unmask(m: re.Match) -> str:
    text, begin, end = m.string, m.start(), m.end()
    if end < len(text) and text[end].isalpha():
        return m.group().translate(DIGITS)
    if begin and text[begin - 1].isalpha():
        bare = m.group().rstrip("!|+")  # signs at the end of a word are punctuation
        return bare.translate(DIGITS) + m.group()[len(bare) :]
    return m.group()


def fold(text: str) -> str:
    """Lower case, no accents, homoglyphs and digit substitutions as Latin letters."""
    try:
        out = text.encode("latin-1").translate(_LATIN).decode("latin-1")
    except UnicodeEncodeError:
        out = text.translate(_FOLD)
    return _MASKS.sub(_unmask, out)


@dataclass(frozen=True)
class Lexicon:
    """``terms``: beginnings of words (or whole words, ending in a space) with their weights.
    ``exceptions``: phrases in which a term does not count. ``slope``, ``shift`` and ``soft``
    turn the weight of a text's hits over its softened length into a probability."""

    terms: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    slope: float = 1.0
    shift: float = -4.0
    soft: int = 50
    _built: list = field(default_factory=list, compare=False, repr=False)

    def automaton(self):
        import ahocorasick

        if not self._built:
            found = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                found.add_word(term.rstrip(), (len(term.rstrip()), weight, term.endswith(" ")))
            for phrase in self.exceptions:
                found.add_word(phrase, (len(phrase), None, True))
            if self.terms:
                found.make_automaton()
            self._built.append(found)
        return self._built[0]

    def __getstate__(self):
        return {**self.__dict__, "_built": []}

    def weigh(self, text: str) -> tuple[float, int, int]:
        """Total weight of the hits, their number, and the number of words."""
        line = fold(text)
        words = len(line.split())
        if not words or not self.terms:
            return 0.0, 0, words
        hits, excused = {}, []
        for last, (size, weight, whole) in self.automaton().iter(line):
            begin = last - size + 1
            if begin and line[begin - 1].isalnum() or whole and line[last + 1 : last + 2].isalnum():
                continue
            if weight is None:
                excused.append((begin, last))
            else:
                hits[begin] = max(weight, hits.get(begin, 0.0))
        for a, z in excused:
            for begin in [b for b in hits if a <= b <= z]:
                del hits[begin]
        return sum(hits.values()), len(hits), words

    def measure(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        return weight / np.sqrt(words + self.soft)

    def probability(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.measure(weight, words) + self.shift, -500, 500)))


def _beginnings(word: str, least: int, longest: int) -> Iterable[str]:
    if len(word) >= least:
        yield word + " "
    for n in range(least, min(len(word), longest) + 1):
        yield word[:n]


def learn(
    rows: list[tuple[int, list[str]]],
    least_share: float = 0.02,
    least_rows: int = 5,
    precision: float = 0.9,
    least: int = 4,
    longest: int = 8,
    most_terms: int = 2000,
    soft: int = 50,
) -> Lexicon:
    """A lexicon from (label, folded words in order) rows.

    A term must begin words of ``least_share`` (and ``least_rows``) of the texts of label 1, and
    ``precision`` of the texts that hold it must have label 1, classes weighed alike. Its
    weight is the log ratio of its class frequencies. Of terms that begin
    one another, the most frequent, then the longest stays. A phrase of a term's word and a neighbour that is
    found in three texts or more, and mostly in texts of label 0, excuses the term.
    """
    bad = [set(w) for y, w in rows if y > 0]
    good = [set(w) for y, w in rows if y <= 0]
    support = max(least_rows, least_share * len(bad))
    counts = Counter(t for words in bad for t in {b for w in words for b in _beginnings(w, least, longest)})
    counts = {t: n for t, n in counts.items() if n >= support}
    begins: dict[str, tuple[str, ...]] = {}
    against = Counter()
    for words in good:
        held = set()
        for w in words:
            if w not in begins:
                begins[w] = tuple(b for b in _beginnings(w, least, longest) if b in counts)
            held.update(begins[w])
        against.update(held)
    terms: dict[str, float] = {}
    for term in sorted(counts, key=lambda t: (-counts[t], -len(t.rstrip()), t.endswith(" "), t)):
        p, q = (counts[term] + 0.5) / (len(bad) + 1), (against[term] + 0.5) / (len(good) + 1)
        if p / (p + q) < precision or len(terms) >= most_terms:
            continue
        if not any(term.startswith(t) or t.startswith(term) for t in terms):
            terms[term] = float(np.log(p / q))
    beginning = tuple(terms)
    phrases = [Counter(), Counter()]
    for y, words in rows:
        own = set()
        for i, w in enumerate(words if beginning else ()):
            if (w + " ").startswith(beginning):
                own.update(" ".join(words[max(0, a) : z]) for a, z in ((i - 1, i + 1), (i, i + 2)) if z - max(0, a) == 2 and z <= len(words))
        phrases[int(y > 0)].update(own)
    excused = frozenset(p for p, n in phrases[0].items() if n >= 3 and n > 3 * phrases[1][p])
    lexicon = Lexicon(terms, excused, soft=soft)
    if not rows:
        return lexicon
    found = [lexicon.weigh(" ".join(w)) for _, w in rows]
    x = lexicon.measure(np.array([f[0] for f in found]), np.array([f[2] for f in found]))
    y = np.array([float(r[0] > 0) for r in rows])
    slope, shift = 1.0, -2.0
    for _ in range(100):  # penalised logistic regression on the one measure
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        v = p * (1 - p)
        a, b, c = (v * x * x).sum() + 0.01, (v * x).sum(), v.sum() + 0.01
        g, h = ((p - y) * x).sum() + 0.01 * slope, (p - y).sum() + 0.01 * shift
        det = a * c - b * b
        slope, shift = float(np.clip(slope - (c * g - b * h) / det, 0.0, 50.0)), float(np.clip(shift - (a * h - b * g) / det, -20.0, 20.0))
    return Lexicon(terms, excused, slope, shift, soft)


def _sketch(batch: Texts) -> np.ndarray:
    """The smallest hash of five words of each text (of its words, if fewer)."""
    begin, end, first = batch.words()
    words = batch.span_hashes(batch.prefix_hashes(batch.data), begin, end)
    out = np.zeros(len(batch), U)
    for i in range(len(batch)):
        own = words[first[i] : first[i + 1]]
        out[i] = gram_hashes(own, min(5, len(own))).min() if len(own) else U(0)
    return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    label: str = "label",
    key: str = "doc_id",
    most_rows: int = 8000,
    **options,
) -> Lexicon:
    """``learn`` from at most ``most_rows`` rows of ``labels``, those of the smallest hash of ``key``.

    The bound is a parameter; it limits what the driver holds, folded words of that many texts.
    Of texts that share their smallest hash of five words, copies most likely, one counts. NULL
    labels and labels without a document are left out.
    """
    sample = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .select(F.col(label).cast("int").alias("_label"), F.col(key).alias("_key"))
        .orderBy(F.xxhash64("_key"), "_key", "_label")
        .limit(most_rows)
    )
    known = docs.join(F.broadcast(sample), F.col(key) == F.col("_key")).select(
        F.col("_label").alias("label"), F.col(text).alias("text")
    )
    names = T.StructType(
        [T.StructField("label", T.IntegerType()), T.StructField("sketch", T.LongType()), T.StructField("words", T.StringType())]
    )

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in texts(batches, "text"):
            words = [" ".join(_WORD.findall(fold(t or ""))) for t in batch.column("text").to_pylist()]
            columns = [batch.column("label"), pa.array(_sketch(own).astype(np.int64), pa.int64()), pa.array(words, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names.names)

    once = {}
    for r in sorted(map(tuple, known.mapInArrow(folded, names).collect())):
        once.setdefault((r[0], r[1]), (r[0], r[2].split()))
    return learn(list(once.values()), **options)


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Add ``score``, ``n_hits`` and ``hit_weight`` to every row; all columns stay.

    Whole texts are read; only the text counts. NULL and empty texts have no hit and get the
    score of the shift alone. The lexicon, bounded by ``most_terms``, is broadcast as plain values. An
    own column that bears an output's name is returned as ``score_own`` and so on.
    """
    docs = making_room(docs, ("score", "n_hits", "hit_weight"))
    sent = docs.sparkSession.sparkContext.broadcast(
        (dict(lexicon.terms), lexicon.exceptions, lexicon.slope, lexicon.shift, lexicon.soft)
    )
    names = [f.name for f in docs.schema.fields]
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType()), T.StructField("hit_weight", T.DoubleType())]
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [lexicon.weigh(t or "") for t in part.column(text).to_pylist()]
                weight, words = np.array([f[0] for f in found]), np.array([f[2] for f in found])
                columns = [pa.array(lexicon.probability(weight, words), pa.float64()), pa.array([f[1] for f in found], pa.int64()), pa.array(weight, pa.float64())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *columns], names=schema.names)

    return docs.mapInArrow(scored, schema)
