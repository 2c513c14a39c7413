"""Quality rules by distribution divergence from language references.

Two histograms of a text are compared with those of its language: character classes, and the language's most common words with one
bin for all other words. The references are sums over the documents of the language that pass the base rules. The divergence is the
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). Short texts are too noisy for a verdict and pass it.

**Which languages have a reference.** Those with at least `MIN_DOCUMENTS` texts long enough for a verdict that are also one in
`MOST_LANGUAGES` or more of all such texts, so there are at most so many references, whatever the column holds. Any other document, because it
names no language or a rare one, is compared with every reference and judged by the nearest: it is odd if it is odd in all of them. Without
any reference there is no verdict.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import ranked_per_group
from ..session import pinned

SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
CLASSES = ("space", "symbol", "lower", "upper", "digit", "mark", "other")
COMMON_WORDS = 64
#: Texts with fewer words, or fewer characters that are no space, get no verdict from the histograms.
MIN_WORDS, MIN_CHARS = 50, 100
#: The largest distances: a constant and an allowance that shrinks with the square root of the number of words, as sampling noise does.
CLASS_LIMIT = (0.18, 0.8)
WORD_LIMIT = (0.33, 1.0)
#: Texts long enough for a verdict that make a language a reference.
MIN_DOCUMENTS = 8
#: Languages that name none: blank, and the codes for undetermined, several, uncoded and no linguistic content.
UNNAMED = ("", "und", "mul", "mis", "zxx")
#: One in so many of the texts that are long enough makes a language a reference, if these are `MIN_DOCUMENTS` at least.
MOST_LANGUAGES = 10_000

_TABLE: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of each code point below 65536; those above count as other."""
    if not _TABLE:
        table = np.full(65537, 6, np.uint8)
        for cp in range(65536):
            c = chr(cp)
            if c in SPACE:
                table[cp] = 0
            elif c in SYMBOLS:
                table[cp] = 1
            elif c.isupper():
                table[cp] = 3
            elif c.isalpha():
                table[cp] = 2
            elif c.isdigit():
                table[cp] = 4
            elif cp < 0x250 or 0x2000 <= cp < 0x2070:
                table[cp] = 5
        _TABLE.append(table)
    return _TABLE[0]


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_classes()[np.minimum(points, 65536)], minlength=len(CLASSES)).astype(np.int64)


def plain(word: bytes) -> str:
    """A word for the word histogram: lower case, without marks around it; empty if it has no letter."""
    bare = word.decode().lower().strip(".,;:!?\"'()[]-")
    return bare if any(map(str.isalpha, bare)) else ""


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    seen: dict[tuple, int] = {}
    numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in zip(words, words[1:], words[2:])), np.int64, len(words) - 2)
    if len(seen) == len(numbers):
        return 0
    again = np.bincount(numbers, minlength=len(seen))[numbers] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + len(again)] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            again += line in seen
            seen.add(line)
    return again


def long_enough(words: int, chars: int) -> bool:
    """Whether a text gets a verdict from the histograms."""
    return words >= MIN_WORDS and chars >= MIN_CHARS


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of histograms row by row, with base 2."""
    p, q = (side / np.maximum(side.sum(1, keepdims=True), 1) for side in (p, q))
    m = (p + q) / 2
    total = np.zeros(len(p))
    for side in (p, q):
        total += (side * np.log2(np.divide(side, m, out=np.ones_like(m), where=side > 0))).sum(1)
    return np.sqrt(np.clip(total / 2, 0, 1))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    return float(distances(p[None], q[None])[0])


def base_failed(words: int, repeats: int) -> bool:
    return words < 50 or 100 * repeats > 50 * words


class References:
    """The histograms of the languages that have a reference, as matrices: a text is compared with all of them at once."""

    def __init__(self, found: dict[str, tuple[np.ndarray, list[str], np.ndarray]]):
        width = max((len(words) for _, words, _ in found.values()), default=0)
        self.at = {lang: i for i, lang in enumerate(found)}
        self.classes = np.array([c for c, _, _ in found.values()], float).reshape(len(found), len(CLASSES))
        self.words = np.zeros((len(found), width + 1))
        self._places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, words, counts) in enumerate(found.values()):
            for j, word in enumerate(words):
                self._places[word].append((i, j))
                self.words[i, j] = counts[j]
            self.words[i, width] = counts[-1]

    def __len__(self) -> int:
        return len(self.at)

    def _words_of(self, counts: Counter, total: int, rows: list[int] | None) -> np.ndarray:
        """The text's histogram over the common words of each reference."""
        mine = np.zeros_like(self.words)
        for word, n in counts.items():
            for i, j in self._places.get(word, ()):
                mine[i, j] = n
        mine[:, -1] = total - mine.sum(1)
        return mine if rows is None else mine[rows]

    def nearest(self, lang: str | None, classes: np.ndarray, counts: Counter, total: int) -> tuple[float, float]:
        """Both distances from the reference of the language, or from the nearest one if it has none."""
        rows = [self.at[lang]] if lang in self.at else None
        of_classes, of_words = (m if rows is None else m[rows] for m in (self.classes, self.words))
        by_class = distances(np.broadcast_to(classes.astype(float), of_classes.shape), of_classes)
        by_word = distances(self._words_of(counts, total, rows), of_words)
        best = int(np.argmin(np.maximum(by_class / limit(CLASS_LIMIT, total), by_word / limit(WORD_LIMIT, total))))
        return float(by_class[best]), float(by_word[best])


def references(rows: DataFrame, common: int = COMMON_WORDS) -> References:
    """Per language: class counts, its most common words, and their counts with that of all other words at the end.

    Each task adds up what it reads and hands out partial counts; only `common` words a language that has a reference come to the driver.
    """
    rows = rows.filter(F.col("lang").isNotNull() & ~F.lower(F.trim("lang")).isin(*UNNAMED))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(langs, kinds, names, counts):
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(names, pa.string()), pa.array(counts, pa.int64())],
                names=["lang", "kind", "name", "n"],
            )

        def flush():
            found = [(lang, 1, w, n) for lang, c in words.items() for w, n in c.items()]
            found += [(lang, 0, str(i), int(n)) for lang, c in classes.items() for i, n in enumerate(c)]
            words.clear()
            classes.clear()
            for at in range(0, len(found), 50_000):
                yield out(*zip(*found[at:at + 50_000]))

        classes: dict = defaultdict(lambda: np.zeros(len(CLASSES) + 1, np.int64))  # at the end: texts long enough for a verdict
        words: dict = defaultdict(Counter)
        for batch in batches:
            raw: dict = defaultdict(Counter)
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py() or ""
                found = text.encode().split()
                if base_failed(len(found), repeated_words(found)):
                    continue
                kinds = class_counts(text)
                classes[lang] += np.append(kinds, long_enough(len(found), len(text) - int(kinds[0])))
                raw[lang].update(found)
            for lang, counts in raw.items():
                for w, n in counts.items():
                    words[lang][plain(w)] += n
            if sum(map(len, words.values())) > 500_000 or len(classes) > 50_000:
                yield from flush()
        yield from flush()

    sums = pinned(rows.mapInArrow(count, "lang string, kind int, name string, n long").groupBy("lang", "kind", "name").agg(F.sum("n").alias("n")))
    support = sums.filter((F.col("kind") == 0) & (F.col("name") == str(len(CLASSES)))).select("lang", F.col("n").alias("documents"))
    total = support.agg(F.sum("documents")).first()[0] or 0
    # At most MOST_LANGUAGES rows, each with its share of all texts.
    used = [(r.lang,) for r in support.filter(F.col("documents") >= max(MIN_DOCUMENTS, total / MOST_LANGUAGES)).orderBy(F.desc("documents"), "lang").collect()]
    if not used:
        return References({})
    sums = sums.join(F.broadcast(sums.sparkSession.createDataFrame(used, "lang string")), "lang")
    most = ranked_per_group(sums.filter("kind = 1 and name <> ''"), ["lang"], [F.desc("n"), F.asc("name")], common).collect()
    classes = defaultdict(lambda: np.zeros(len(CLASSES) + 1))
    for r in sums.filter("kind = 0").collect():
        classes[r.lang][int(r.name)] = r.n
    all_words = {r.lang: r.n for r in sums.filter("kind = 1").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    tops = defaultdict(list)
    for r in sorted(most, key=lambda r: r.position):
        tops[r.lang].append((r.name, r.n))
    return References({
        lang: (classes[lang][:-1], [w for w, _ in tops[lang]], np.array([n for _, n in tops[lang]] + [all_words.get(lang, 0) - sum(n for _, n in tops[lang])], float))
        for lang, in used
    })


VERDICT = (
    "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, class_distance double, word_distance double"
)


def limit(of: tuple[float, float], words: int) -> float:
    return of[0] + of[1] / words ** 0.5


def judge(text: str | None, lang: str | None, refs: References) -> tuple:
    """The verdict on one text, in the order of `VERDICT` without the id."""
    text = text or ""
    words = text.encode().split()  # bytes: splits on 20 and 09-0D only
    classes = class_counts(text)
    repeats = repeated_words(words)
    chars = len(text) - int(classes[0])
    failed = base_failed(len(words), repeats)
    by_class = by_word = None
    odd = False
    if len(refs) and long_enough(len(words), chars):
        counts: Counter = Counter()
        for w, n in Counter(words).items():
            counts[plain(w)] += n
        by_class, by_word = refs.nearest(lang, classes, counts, len(words))
        odd = by_class > limit(CLASS_LIMIT, len(words)) or by_word > limit(WORD_LIMIT, len(words))
    return (len(words), chars, int(classes[1]), repeated_lines(text), repeats, failed, not failed and not odd, by_class, by_word)


def _rows(docs: DataFrame, first, lang: str, text: str) -> DataFrame:
    return docs.select(first, F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))


def _judge_all(batch: pa.RecordBatch, refs: References) -> list[tuple]:
    return [judge(t.as_py(), lang, refs) for lang, t in zip(batch.column(1).to_pylist(), batch.column(2))]


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", common: int = COMMON_WORDS) -> DataFrame:
    """One row per document: the base counts, `base_failed`, `kept` and both distances (null where the length guard passed it).

    A null text counts as empty and fails the base rule. Without a language that has a reference the nearest one judges; without any
    reference the distances are null and the text passes. Repeated rows are judged each. An empty table gives an empty result. Other columns are ignored.
    """
    rows = _rows(docs, F.col(key).cast("long").alias("id"), lang, text)
    refs = references(rows, common)
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    names = [field.split()[0] for field in VERDICT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _judge_all(batch, refs)
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return rows.mapInArrow(run, VERDICT).withColumnRenamed("id", key)


def passing(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON_WORDS) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns, judged where they are read: no shuffle."""
    refs = references(_rows(docs, F.lit(0).alias("id"), lang, text), common)
    rows = _rows(docs, F.struct("*").alias("row"), lang, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([f[6] for f in _judge_all(batch, refs)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], names=["row"])

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
