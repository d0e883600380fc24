"""Quality rules: base counts, and divergence from the character and word habits of the corpus's languages.

References. For each value of `lang`, the characters of all documents are counted by class and their words by word; the
COMMON most frequent words of a language, with one bin for all others, make its word histogram. Counts cover every document
and every copy of it, whatever the number of rows, and are pre-aggregated in each task. A value of lang with fewer than
MIN_REFERENCE_WORDS words is too short to show a language's habits and is no reference; nothing else decides that, so rows of
other languages never remove one. References travel to the tasks while they take at most REFERENCE_BYTES; beyond that they go in groups,
each in a pass of its own, and a document takes the nearest over all passes: the same verdicts.

Verdict. A document that passes the base rules is compared with every reference by Jensen-Shannon distance (base 2, so 0 to
1), and the nearest language decides. Both distances must lie below their limits. Short texts scatter more, so a limit grows
by SCATTER (characters) or WORD_SCATTER (words) / sqrt(n), and a histogram of fewer than MIN_CHARS characters or MIN_WORDS words is no evidence: it is not tested.

Cases: null and empty texts have zero counts and fail the base rules; very long texts are counted whole; words of equal
frequency rank by their bytes, languages at equal distance by name; lang may be null (a reference of its own) and is used for
nothing but the references; documents of a language that is no reference are compared with those that are, and without any
reference only the base rules decide; an empty table gives an empty result; rows that repeat an id are judged each for itself;
columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.common import bounded_batches, materialise, text_bytes, text_rows

COMMON = 100
MIN_CHARS = 200
MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.20
MAX_WORD_DISTANCE = 0.35
SCATTER = 1.25
WORD_SCATTER = 1.5
MIN_BASE_WORDS = 50
HELD_WORDS = 200_000
SALTS = 64
MIN_REFERENCE_WORDS = 1000
#: What the references may take in a task and on the driver; a row of one is a word or a class with its count.
REFERENCE_BYTES = 16 << 20
ROW_BYTES = 256
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "mark", "symbol", "control", "letter_beyond_ascii")


def _class_matrix() -> np.ndarray:
    """256 x classes: the class of each byte that begins a character; bytes that continue one count nowhere."""
    at = np.zeros((256, len(CLASSES)))
    for byte in range(256):
        c = chr(byte)
        if byte >= 0xC0:
            name = "letter_beyond_ascii"
        elif byte >= 0x80:
            continue
        elif c.isalpha():
            name = "upper" if c.isupper() else "lower"
        elif c.isdigit():
            name = "digit"
        elif c == "\n":
            name = "newline"
        elif c in " \t":
            name = "blank"
        elif c in ".,":
            name = "stop"
        elif c in "!?;:'\"-()":
            name = "mark"
        else:
            name = "symbol" if byte > 32 else "control"
        at[byte, CLASSES.index(name)] = 1
    return at


BYTE_CLASS = _class_matrix()
SPACE_BYTES = np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8)
SYMBOL_BYTES = np.frombuffer(SYMBOLS, dtype=np.uint8)


def byte_histogram(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    marked = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= marked
    return int(covered.sum())


def base_counts(text: bytes, words: list[bytes], seen: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. `seen` is the text's byte histogram."""
    starts = int(seen[:0x80].sum() + seen[0xC0:].sum())
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    n, repeated = len(words), repeated_words(words)
    failed = n < MIN_BASE_WORDS or 100 * repeated > 50 * n
    return n, starts - int(seen[SPACE_BYTES].sum()), int(seen[SYMBOL_BYTES].sum()), len(lines) - len(set(lines)), repeated, failed


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word or null, class, n): words and character classes, summed while memory allows."""
    words: dict[str | None, Counter] = {}
    chars: dict[str | None, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, w, None, n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, None, k, int(n)) for lang, c in chars.items() for k, n in enumerate(c)]
        words.clear()
        chars.clear()
        lang, word, kind, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(kind, pa.int32()), pa.array(n, pa.int64())], names=["lang", "word", "kind", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            words.setdefault(lang, Counter()).update(text.split())
            chars[lang] = chars.get(lang, 0) + byte_histogram(text) @ BYTE_CLASS
            if sum(map(len, words.values())) > HELD_WORDS:
                yield flush()
    yield flush()


def references(docs: DataFrame, common: int = COMMON, least_words: int = 0) -> DataFrame:
    """lang, kind, word, n: class counts (word null) and the `common` most frequent words with `total` of each language of at
    least `least_words` words."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = rows.mapInArrow(_count, "lang string, word binary, kind int, n long")
    summed = materialise(counted.groupBy("lang", "word", "kind").agg(F.sum("n").alias("n")), "word_counts")  # read for classes, words and totals
    classes = summed.filter("word is null").withColumn("total", F.lit(None).cast("long"))
    words = summed.filter("word is not null")
    # first within SALTS parts of a language, then among what is left of them: no task ranks all words of a language
    order, salt = [F.col("n").desc(), F.col("word")], F.pmod(F.xxhash64("word"), F.lit(SALTS))
    ranked = words.withColumn("salt", salt).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("nth") <= common)
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("nth") <= common).drop("salt")
    totals = words.groupBy(F.col("lang").alias("__lang")).agg(F.sum("n").alias("total")).filter(F.col("total") >= least_words)
    top = ranked.join(totals, F.col("lang").eqNullSafe(F.col("__lang"))).drop("nth", "__lang")
    classes = classes.join(totals.select("__lang"), F.col("lang").eqNullSafe(F.col("__lang")), "left_semi")
    return classes.unionByName(top)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each row of q to p, both normalised along the last axis; base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


class References:
    """The collected references: one row of class shares and one of word shares per language."""

    def __init__(self, rows: list):
        langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is None, x or ""))
        place = {lang: i for i, lang in enumerate(langs)}
        self.langs = langs
        self.chars = np.zeros((len(langs), len(CLASSES)))
        self.words: list[dict[bytes, int]] = [{} for _ in langs]
        counts: list[list[float]] = [[] for _ in langs]
        totals = [0] * len(langs)
        for r in sorted(rows, key=lambda r: (-r["n"], bytes(r["word"] or b""))):
            i = place[r["lang"]]
            if r["word"] is None:
                self.chars[i, r["kind"]] = r["n"]
            else:
                self.words[i][bytes(r["word"])] = len(self.words[i])
                counts[i].append(r["n"])
                totals[i] = r["total"]
        self.chars /= np.maximum(self.chars.sum(1, keepdims=True), 1)
        self.word_shares = [np.asarray([*c, t - sum(c)]) / max(t, 1) for c, t in zip(counts, totals, strict=True)]
        self.all_words = {w for x in self.words for w in x}

    def distances(self, seen: np.ndarray, words: list[bytes]) -> tuple[float, float, str | None]:
        """Character and word distance to the nearest language (by their sum), and that language."""
        best = (0.0, 0.0, None)
        classes = seen @ BYTE_CLASS
        total, n = classes.sum(), len(words)
        if not len(self.words) or not total:
            return best
        near = jensen_shannon(classes / total, self.chars)
        common = Counter(filter(self.all_words.__contains__, words))
        for i, index in enumerate(self.words):
            own = np.zeros(len(index) + 1)
            for w, c in common.items():
                if w in index:
                    own[index[w]] = c
            own[-1] = n - own.sum()
            far = float(jensen_shannon(own / max(n, 1), self.word_shares[i])) if n else 0.0
            if not i or near[i] + far < best[0] + best[1]:
                best = float(near[i]), far, self.langs[i]
        return best


def accept(n_chars: int, n_words: int, chars: float, words: float) -> bool:
    char_ok = n_chars < MIN_CHARS or chars <= MAX_CHAR_DISTANCE + SCATTER / n_chars**0.5
    return char_ok and (n_words < MIN_WORDS or words <= MAX_WORD_DISTANCE + WORD_SCATTER / n_words**0.5)


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double, nearest string"


def _judge(known: References):
    """Columns before the last stay as they are; the last is a text, which is judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2 + [pa.string()]
        names = [x.split()[0] for x in RESULT.split(", ")][1:]
        for batch in batches:
            rows = []
            for text in text_bytes(batch.columns[-1]):
                words, seen = text.split(), byte_histogram(text)
                base = base_counts(text, words, seen)
                chars, far, lang = known.distances(seen, words)
                rows.append((*base, not base[-1] and accept(base[1], base[0], chars, far), chars, far, lang))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            arrays = [*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], *names])

    return run


def judge_in_groups(docs: DataFrame, known: DataFrame, groups: int) -> DataFrame:
    """Judged by one group of languages after the other; the nearest of all decides, at equal distance the first by name."""
    numbered = materialise(text_rows(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "judged_texts")
    judged = None
    for g in range(groups):
        own = References(known.filter(F.pmod(F.xxhash64("lang"), F.lit(groups)) == g).collect())
        if own.langs or (g == groups - 1 and judged is None):
            part = materialise(numbered.mapInArrow(_judge(own), f"row long, {RESULT}"), "judged")
            judged = part if judged is None else judged.unionByName(part)
    order = F.struct(F.col("char_distance") + F.col("word_distance"), F.col("nearest").isNull(), "nearest")
    columns = [x.split()[0] for x in RESULT.split(", ")]
    return judged.groupBy("row").agg(F.min_by(F.struct(*columns), order).alias("x")).select("x.*")


def judge(docs: DataFrame, reference_bytes: int = REFERENCE_BYTES) -> DataFrame:
    """Base counts, verdict, both distances and the nearest language of every document."""
    known = materialise(references(docs, least_words=MIN_REFERENCE_WORDS), "references")  # COMMON words and ten classes for each language
    groups = -(-known.count() * ROW_BYTES // reference_bytes)
    if groups > 1:
        return judge_in_groups(docs, known, groups)
    return text_rows(docs).mapInArrow(_judge(References(known.collect())), RESULT)
