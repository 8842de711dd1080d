"""Spelling variants: words that differ by one code point, each with the more frequent word that it stands for.

A word of at most one edit keeps one of its two halves unchanged, the first at its beginning or the second at its end.
Shards of the vocabulary hold both halves of each of their words in an Aho-Corasick automaton. All words are scanned by
the shards of their own length and of one less; where a half is found at such a place, the shard's words with that half
are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, short, written

#: Letters of the runs that are words.
LETTERS = "A-Za-zÀ-ÿ"
#: Words of an automaton shard, and words that a task scans with it.
BLOCK = 65_536
#: Characters of a text, and distinct words of several, that a task counts before it hands them on.
WINDOW, HELD = 1 << 20, 200_000
_RUN, _END = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
_HIDDEN = "\0"


def runs(text: str) -> Counter:
    """Counts of the runs of letters, only A-Z lower-cased. The text is read in windows that end outside runs."""
    low = text.encode().lower().decode()
    found: Counter = Counter()
    at = 0
    while at < len(low):
        stop = _END.search(low, at + WINDOW)
        end = stop.start() if stop else len(low)
        found.update(_RUN.findall(low, at, end))
        at = end
    return found


def misspelt(run: str, prefix: int, one_in: int) -> str:
    """``run``, without one code point if ``one_in`` divides its hash, whose state after the id is ``prefix``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % one_in:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counted(least: int, one_in: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(f"{doc}:".encode())
                for word, n in runs(text).items():
                    if one_in:
                        word = misspelt(word, prefix, one_in)
                    if len(word) >= least:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield _counts(held)
                    held = {}
        yield _counts(held)

    return run


def _counts(held: dict[str, int]) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, one_in: int | None = None) -> DataFrame:
    """(word, n) of the runs of letters of all texts, those of enough code points and occurrences.

    With ``one_in`` one in so many runs of each document loses a code point first, by a hash of the document's id and
    the run: planted misspellings. Null texts have no words; a null id is hashed as an empty one; rows that repeat count
    each time. Counts are added up in the tasks before they are shuffled.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col(f"`{text_col}`")).where(F.col(f"`{text_col}`").isNotNull())
    counts = rows.mapInArrow(_counted(least_length, one_in), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class HalvesAutomaton:
    """The two halves of words of one length, and the words themselves for verification.

    ``same`` and ``longer`` give the places of the words that differ from a scanned word by a replaced code point, or by
    one that it has more. Which half occurs tells in which half the edit lies; the words with that half are looked up by
    what they are without the edited code point, so that a common half costs no more than a rare one.
    """

    def __init__(self, words: list[str]):
        import ahocorasick

        self.words, self.length = words, len(words[0])
        self.half = self.length // 2
        kinds: dict[str, int] = {}
        for w in words:
            for part, kind in ((w[: self.half], 1), (w[self.half :], 2)):
                kinds[part] = kinds.get(part, 0) | kind
        self._automaton = ahocorasick.Automaton()
        for part, kind in kinds.items():
            self._automaton.add_word(part, kind)
        self._automaton.make_automaton()
        self._whole = {w: k for k, w in enumerate(words)}
        self._hidden: dict[str, int] | None = None
        self._next: list[int] = []

    def halves(self, word: str) -> tuple[bool, bool]:
        """Whether ``word`` begins with a first half, and whether it ends with a second half, of some word held."""
        first = second = False
        for end, kind in self._automaton.iter(word):
            if kind & 1 and end == self.half - 1:
                first = True
            if kind & 2 and end == len(word) - 1:
                second = True
        return first, second

    def _hide(self) -> None:
        """For each word and place the word without that code point; equal ones are chained."""
        self._hidden, self._next = {}, []
        for w in self.words:
            for j in range(self.length):
                key = w[:j] + _HIDDEN + w[j + 1 :]
                self._next.append(self._hidden.get(key, -1))
                self._hidden[key] = len(self._next) - 1

    def same(self, word: str) -> list[int]:
        if self._hidden is None:
            self._hide()
        first, second = self.halves(word)
        out = []
        for j in range(0 if second else self.half, self.length if first else self.half):
            entry = self._hidden.get(word[:j] + _HIDDEN + word[j + 1 :], -1)
            while entry >= 0:
                if self.words[entry // self.length] != word:
                    out.append(entry // self.length)
                entry = self._next[entry]
        return out

    def longer(self, word: str) -> set[int]:
        first, second = self.halves(word)
        places = range(0 if second else self.half, self.length + 1 if first else self.half + 1)
        found = {self._whole.get(word[:j] + word[j + 1 :], -1) for j in places} if first or second else set()
        return found - {-1}


def _scan(group: pa.Table) -> pa.Table:
    """Near words of a group's scanned words among its held ones: for each word the count and the best, as partial sums."""
    words, counts, held = (group.column(c).to_pylist() for c in ("word", "n", "held"))
    index = [k for k, h in enumerate(held) if h]
    scanned = [k for k, h in enumerate(held) if not h]
    best: dict[int, tuple[int, int, str]] = {}

    def near(k: int, other: int) -> None:
        total, n, word = best.get(k, (0, 0, ""))
        if (-counts[other], words[other]) < (-n, word):
            n, word = counts[other], words[other]
        best[k] = (total + 1, n, word)

    if index and scanned:
        shard = HalvesAutomaton([words[k] for k in index])
        equal = len(words[scanned[0]]) == shard.length
        for k in scanned:
            if equal:
                for at in shard.same(words[k]):
                    near(k, index[at])
            else:
                for at in shard.longer(words[k]):
                    near(k, index[at])
                    near(index[at], k)
    rows = list(best.items())
    return pa.table({"word": pa.array([words[k] for k, _ in rows], pa.string()), "n_near": pa.array([b[0] for _, b in rows], pa.int64()), "near_n": pa.array([b[1] for _, b in rows], pa.int64()), "near": pa.array([b[2] for _, b in rows], pa.string())})


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near, near_n): for each word of ``words`` (word, n), which are distinct and not null, how many
    others differ by exactly one inserted, deleted or replaced code point, and of those the one of largest n, ties by
    code points. Words without any have no row.

    A task holds a block of words of one length and scans a block of words of that length or of one more, whatever the
    size of the vocabulary. The work is that of all words by the number of shards of their length.
    """
    sized = words.withColumn("size", F.char_length("word"))
    blocks = short(written(sized.groupBy("size").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "lengths"))
    others = blocks.select((F.col("size") - 1).alias("size"), F.col("blocks").alias("more"))
    placed = sized.join(blocks, "size").join(others, "size", "left")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    fewer = blocks.select((F.col("size") + 1).alias("size"), F.col("blocks").alias("fewer"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    none = F.array().cast("array<struct<shard:int,hold:int,longer:boolean,scan:int,held:boolean>>")
    role = lambda shard, hold, longer, scan, held: F.struct(shard.cast("int").alias("shard"), hold.cast("int").alias("hold"), F.lit(longer).alias("longer"), scan.cast("int").alias("scan"), F.lit(held).alias("held"))
    size, own = F.col("size"), F.col("own")
    roles = F.concat(
        F.transform(every(F.col("blocks")), lambda k: role(size, own, False, k, True)),
        F.transform(every(F.col("blocks")), lambda k: role(size, k, False, own, False)),
        F.when(F.col("more").isNull(), none).otherwise(F.transform(every(F.col("more")), lambda k: role(size, own, True, k, True))),
        F.when(F.col("fewer").isNull(), none).otherwise(F.transform(every(F.col("fewer")), lambda k: role(size - 1, k, True, own, False))),
    )
    dealt = placed.join(fewer, "size", "left").select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.*")
    found = dealt.groupBy("shard", "hold", "longer", "scan").applyInArrow(_scan, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows of ``forms`` (word, form): where following forms ends. Forms must not run in circles.

    Pointers are doubled: each round, written to the shared folder, halves what is left of every path.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        stepped = written(at.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        forget(at.sparkSession, at)
        at = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return at


def spelling_forms(words: DataFrame, ratio: int = 2, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of ``words`` (word, n).

    A word's form is its most frequent near word if that is at least ``ratio`` times as frequent, with ratio > 1; its
    root is where its forms lead to, the word itself without one. An empty vocabulary gives no rows; other columns are
    not read.
    """
    words = written(words.select("word", "n"), "words")
    near = words.join(near_words(words, block), "word", "left")
    takes = F.col("near_n") >= ratio * F.col("n")
    judged = near.select("word", F.when(takes, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("near_n")).alias("form_n"))
    judged = written(judged, "forms")
    led = roots(judged.where("form is not null"))
    return judged.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
