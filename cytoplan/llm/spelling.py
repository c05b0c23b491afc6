"""Spelling variants: words grouped with their near words, without pairs (operator 11).

Words are runs of letters, counted over all documents. Two words are near if one inserted, deleted or replaced code point turns one into the
other. Near words are not paired up; words that could be near meet in groups:

1. Replacements. A word is in one group for each of its places, whose key is what stands before the place and what stands behind it. All other
   words of such a group differ from it in that place alone. A group keeps its size and its first two words (most
   occurrences, then code-point order): a word's best partner there is the first, or the second if it is the first itself.
2. Insertions and deletions. A word emits each different word that deleting one code point gives (one key for each run of equal
   letters). These keys are joined with the vocabulary: a word that is one of them has as many longer near words as the key has
   others, and they have it as their shorter one.

Two replaced words meet in one group alone, and so do a word and one of its deletions, so sums over the groups count near words exactly, and the best of the groups' best is the near
word of most occurrences. No group can be larger than the alphabet (for deletions, than the alphabet times the places of a word), whatever the corpus,
and a word has about two keys for each of its letters, so rows grow with the vocabulary and never with the pairs.

A word's form is its best near word, if that has RATIO times its occurrences. Forms have forms; each step has RATIO times more
occurrences, so chains are short, and are followed by joining the table of forms with itself, twice as far each round.

Words of more than SHORT code points have 128-bit hashes of what stands before and behind the place as keys, extended letter by letter from both ends, so a word of a million letters
makes keys in proportion to its length.

Counting simulates what a corpus has of dropped letters as its contract states: a run whose CRC with its document's id is a multiple of DROP loses one letter.

Defined cases: null and empty texts have no words; a null doc_id stands as nothing before the colon; repeated rows count each; ties of occurrences go to the smaller word; very long texts and runs
are read whole; an empty table gives an empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoplan.llm.common import written

LEAST_LENGTH, LEAST_COUNT, RATIO, DROP = 7, 2, 10, 31
#: Code points up to which keys are the letters themselves.
SHORT = 64
#: Different words that a task holds at most before it hands on their counts, and keys in a batch.
HELD, KEYS = 200_000, 50_000
#: Kinds of keys: of a word itself, of a deletion, of a replacement.
ITSELF, DELETION, REPLACEMENT = 0, 1, 2


def _counted(batches: Iterator[pa.RecordBatch], least_length: int) -> Iterator[pa.RecordBatch]:
    run = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
        total.clear()
        return rows

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            lower = (text.as_py() or "").encode().lower().decode()  # of bytes: A-Z alone
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for word, n in Counter(run.findall(lower)).items():
                h = zlib.crc32(word.encode(), start)
                if h % DROP == 0:
                    k = h % len(word)
                    word = word[:k] + word[k + 1 :]
                    if len(word) < least_length:
                        continue
                total[word] += n
            if len(total) > HELD:
                yield out()
    yield out()


def vocabulary(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, of words of least_length code points and least_count occurrences in all documents."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = docs.mapInArrow(lambda b: _counted(b, least_length), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _heads(word: str) -> list[str]:
    """Hashes of the first 0, 1, 2 ... code points."""
    h = xxhash.xxh3_128()
    out = [h.hexdigest()]
    for c in word:
        h.update(c.encode())
        out.append(h.hexdigest())
    return out


def keys_of(word: str) -> Iterator[tuple[str, int]]:
    """The keys of a word's groups, with their kinds. Keys of replacements hold an asterisk, which is no letter."""
    n = len(word)
    ends = [i for i in range(n) if i == n - 1 or word[i] != word[i + 1]]  # deletions within a run of equal letters are the same
    if n > SHORT:
        heads, tails = _heads(word), _heads(word[::-1])[::-1]
    if n <= SHORT:
        yield word, ITSELF
        for i in range(n):
            yield f"{word[:i]}*{word[i + 1 :]}", REPLACEMENT
    else:
        for i in range(n + 1):  # where a longer word has the letter more
            yield f"{i}-{heads[i]}{tails[i]}", ITSELF
        for i in range(n):
            yield f"{i}*{heads[i]}{tails[i + 1]}", REPLACEMENT
    for i in ends:
        yield f"{word[:i]}{word[i + 1 :]}" if n - 1 <= SHORT else f"{i}-{heads[i]}{tails[i + 1]}", DELETION


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, int, str, int]] = []

    def out() -> pa.RecordBatch:
        key, kind, word, n = zip(*rows, strict=True)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(kind, pa.int8()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["key", "kind", "word", "n"])

    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            size = 0
            for key, kind in keys_of(word):
                rows.append((key, kind, word, n))
                size += len(key) + len(word)
                if len(rows) >= KEYS or size > 1 << 24:
                    size = 0
                    yield out()
    if rows:
        yield out()


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best and best_n, for every word (word, n) that has a near word."""
    keyed = words.select("word", "n").mapInArrow(_keyed, "key string, kind byte, word string, n long")
    group = Window.partitionBy("key")
    ordered = group.orderBy(F.col("kind") != ITSELF, F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct("kind", (-F.col("n")).alias("less"), "word")
    met = keyed.select("word", "kind", F.count(F.lit(1)).over(group).alias("size"), F.first(one).over(ordered).alias("first"), F.nth_value(one, 2).over(ordered).alias("second"))
    # Deletions of several words that are no word themselves are no near words of each other.
    met = met.where((F.col("size") > 1) & ((F.col("kind") == REPLACEMENT) | (F.col("first.kind") == ITSELF)))
    partner = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    near = F.when(F.col("kind") == DELETION, 1).otherwise(F.col("size") - 1)
    best = F.min(F.struct(partner["less"].alias("less"), partner["word"].alias("word")))
    found = met.groupBy("word").agg(F.sum(near).cast("long").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last form of the chain that begins at word. forms: word, form, free of circles."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(64):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        both = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        now = both.select("word", "root")
        if both.where("moved").isEmpty():
            return now
    raise RuntimeError("the forms go round in circles")


def variants(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary."""
    words = written(vocabulary(documents, least_length, least_count), "words")
    has = F.col("best_n") >= ratio * F.col("n")
    every = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")
    )
    every = written(every, "near")
    last = roots(every.where("form IS NOT NULL"))
    return every.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
