"""Spelling variants: words one edit apart, found by dense comparison inside tiles of a shared prefix and suffix."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carespend.llm.text import LOWER, column_bytes, distinct_words, mask_spans, slices
from carespend.sources.io import stage

#: Code points of the shortest word, and occurrences of the rarest, that take part.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: How many times as often a word must occur to be the form of another.
RATIO = 10
#: Code points in which the words of a tile may differ, at least; long words have at most ``TILES`` tiles.
GAP, TILES = 3, 16
#: Words of a tile that are compared as they are; a larger tile is cut into tiles of one free code point.
BLOCK = 512
#: Rows that a task takes on at a time, about, and matrix cells it compares at a time.
ROWS, CELLS = 50_000, 1 << 24

_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True


def word_counts(docs: DataFrame, slips: int | None = None, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``word, n``: runs of the letters A-Z, a-z and U+00C0 to U+00FF in texts ``doc_id, text``, A-Z lower-cased, with their occurrences.

    With ``slips``, a code point is left out of a run throughout a text where that number divides
    the CRC-32 h of ``<doc_id>:<run>``: the one at h modulo its length. Words of fewer than
    ``least_length`` code points are not counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            starts_of = [zlib.crc32(b"" if i is None else b"%d" % i) for i in batch.column(0).to_pylist()]
            for a, b in slices(offsets):
                lowered = LOWER[data[offsets[a] : offsets[b]]]
                lead = lowered == _LEAD
                held = _LETTER[lowered] | lead
                held[1:] |= lead[:-1]
                text, starts, ends = mask_spans(held, offsets[a : b + 1] - offsets[a])
                leads = np.concatenate([[0], np.cumsum(lead)])
                long = (ends - starts) - (leads[ends] - leads[starts]) >= least_length
                codes, words = distinct_words(lowered, starts[long], ends[long])
                pairs, times = np.unique(text[long] * max(1, len(words)) + codes, return_counts=True)
                whole = np.ones(len(pairs), bool)
                spoken, n = [], []
                if slips:
                    bytes_of = words.to_pylist()
                    base = [zlib.crc32(b":", x) for x in starts_of[a:b]]
                    hashes = [zlib.crc32(bytes_of[k % len(words)], base[k // len(words)]) for k in pairs.tolist()]
                    for k in np.flatnonzero(np.array(hashes, np.int64) % slips == 0).tolist():
                        w = bytes_of[pairs[k] % len(words)].decode()
                        at, whole[k] = hashes[k] % len(w), False
                        if len(w) > least_length:
                            spoken.append(w[:at] + w[at + 1 :])
                            n.append(int(times[k]))
                totals = np.zeros(len(words), np.int64)
                np.add.at(totals, pairs[whole] % max(1, len(words)), times[whole])
                kept = np.flatnonzero(totals)
                column = pa.concat_arrays([words.take(pa.array(kept)).cast(pa.large_string()), pa.array(spoken, pa.large_string())]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([column, pa.array(np.concatenate([totals[kept], np.array(n, np.int64)]))], ["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tiles(words: DataFrame) -> DataFrame:
    """``tile, longer, place, gap, word, n``: each word under the prefixes and suffixes that it can share with a word one edit away.

    Of two such words, ``longer`` code points the longer one, the common prefix and suffix
    together reach ``longer - 1``. With the prefix cut to a multiple of ``gap``, both words have
    the same ``place`` code points in front and the same ``longer - place - gap`` at the end.
    """
    size = F.length("word")
    longer = words.withColumn("longer", F.explode(F.array(size, size + 1)))
    gap = F.greatest(F.lit(GAP), F.ceil(F.col("longer") / TILES).cast("int"))
    placed = longer.withColumn("gap", gap).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("longer") - 1, F.col("gap"))))
    return keyed(placed)


def keyed(placed: DataFrame) -> DataFrame:
    rest = F.greatest(F.lit(0), F.col("longer") - F.col("place") - F.col("gap"))
    front = F.substring("word", F.lit(1), F.col("place"))
    back = F.substring("word", F.length("word") - rest + 1, rest)
    return placed.select(F.xxhash64("longer", "place", front, back).alias("tile"), "longer", "place", "gap", "word", "n")


def finer(large: DataFrame) -> DataFrame:
    """The words of tiles that are too large, under every single place of their gap. As the words are distinct, such a tile has a word per letter at most, and one more."""
    last = F.least(F.col("longer"), F.col("place") + F.col("gap")) - 1
    placed = large.withColumn("place", F.explode(F.sequence(F.col("place"), last))).withColumn("gap", F.lit(1))
    return keyed(placed)


def matrix(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of words, which are below 256, padded to the longest from the left and from the right, and their lengths."""
    data, offsets = column_bytes(words)
    lead = data == _LEAD
    after = np.concatenate([[False], lead[:-1]])
    points = np.where(after, data + np.uint8(0x40), data)[~lead]
    offsets = offsets - np.concatenate([[0], np.cumsum(lead)])[offsets]
    sizes = np.diff(offsets)
    place = np.arange(sizes.max(initial=0))
    front, back = (np.zeros((len(words), len(place)), np.uint8) for _ in range(2))
    front[place < sizes[:, None]] = points
    back[place >= len(place) - sizes[:, None]] = points
    return front, back[:, ::-1], sizes


def _first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = a == b
    at = np.argmin(same, axis=1)
    return np.where(same[np.arange(len(same)), at], same.shape[1], at)


def near_pairs(words: pa.Array, starts: np.ndarray, sizes: np.ndarray, longer: int, place: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words one edit apart; ``starts, sizes, place, gap`` tell the tiles, all of the same ``longer``.

    A pair may meet in several tiles; it counts where the end of its common prefix lies.
    """
    front, back, length = matrix(words)
    found = [(np.zeros(0, np.int64),) * 2]
    for s in np.unique(sizes):
        i, j = np.triu_indices(int(s), 1)
        own = np.flatnonzero(sizes == s)
        together = max(1, CELLS // (max(1, len(i)) * longer))
        for k in range(0, len(own), together):
            some = own[k : k + together]
            strip = max(1, CELLS // (len(some) * longer))
            for c in range(0, len(i), strip):
                a, b = ((starts[some][:, None] + x[None, c : c + strip]).ravel() for x in (i, j))
                tile = np.repeat(some, len(i[c : c + strip]))
                is_long = np.maximum(length[a], length[b]) == longer
                a, b, tile = a[is_long], b[is_long], tile[is_long]
                prefix = _first_difference(front[a], front[b])
                here = (prefix >= place[tile]) & (prefix < place[tile] + gap[tile])
                a, b, prefix = a[here], b[here], prefix[here]
                near = prefix + _first_difference(back[a], back[b]) >= longer - 1
                found.append((a[near], b[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_OUT = "word string, n_near long, best_n long, best string, longer int, place int, gap int, n long"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _summed(words: pa.Array, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Per word the number of its near words here, and the most frequent one, of equals the first in code-point order."""
    one, two = np.concatenate([a, b]), np.concatenate([b, a])
    order_of = np.empty(len(words), np.int64)
    order_of[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((order_of[two], -n[two], one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(one)))
    none = [pa.nulls(len(first), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]
    best = two[first]
    return pa.RecordBatch.from_arrays([words.take(pa.array(one[first])), pa.array(counts, pa.int64()), pa.array(n[best]), words.take(pa.array(best)), *none], _NAMES)


def compared(rows: DataFrame, block: int | None = BLOCK) -> DataFrame:
    """Near words within tiles: ``word, n_near, best_n, best``; rows of tiles of more than ``block`` words come back as they were."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Rows with the starts of their tiles, each tile whole unless it is too large."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = tile_starts(table)
            last = int(starts[-1])
            if last == 0:
                held = table.to_batches()
                if block is not None and len(table) > block:
                    yield table, starts  # too large for certain; the rest of it is known by its key
                    held = []
                continue
            yield table.slice(0, last), starts[:-1]
            held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield table, tile_starts(table)

    def tile_starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for c in ("tile", "longer", "place"):
            x = table[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large: tuple | None = None
        for table, starts in runs(batches):
            longer, place, gap, n, tile = (table[c].to_numpy() for c in ("longer", "place", "gap", "n", "tile"))
            words = pa.concat_arrays(table["word"].chunks)
            sizes = np.diff(np.append(starts, len(table)))
            over = np.zeros(len(starts), bool) if block is None else sizes > block
            keys = list(zip(tile[starts].tolist(), longer[starts].tolist(), place[starts].tolist(), strict=True))
            over[0] |= keys[0] == large
            large = keys[-1] if over[-1] else None
            if over.any():
                rows = pa.array(np.flatnonzero(np.repeat(over, sizes)))
                none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.string())]
                rest = [pa.array(x).take(rows) for x in (longer, place, gap, n)]
                yield pa.RecordBatch.from_arrays([words.take(rows), *none, *rest], _NAMES)
            use = ~over & (sizes > 1)
            for m in np.unique(longer[starts[use]]):
                own = np.flatnonzero(use & (longer[starts] == m))
                upto, cells = np.cumsum(sizes[own]), max(1, CELLS // int(m))
                for part in np.split(own, np.searchsorted(upto, np.arange(cells, upto[-1], cells))):
                    if not len(part):
                        continue
                    rows = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in part.tolist()])
                    some = words.take(pa.array(rows))
                    begins = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
                    a, b = near_pairs(some, begins, sizes[part], int(m), place[starts[part]], gap[starts[part]])
                    if len(a):
                        yield _summed(some, n[rows], a, b)

    dealt = rows.repartition("tile").sortWithinPartitions("tile", "longer", "place")
    return dealt.select("tile", "longer", "place", "gap", "word", "n").mapInArrow(run, _OUT)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n_near, best_n, best``: for words ``word, n`` that have near words, their number and the most frequent one."""
    first = stage(compared(tiles(words), block), "near-words")
    large = first.where("n_near IS NULL").select("word", "longer", "place", "gap", "n")
    found = first.where("n_near IS NOT NULL").unionByName(compared(finer(large), None))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``word, root``: where each word of ``word, form`` ends when forms are followed. Forms are ever more frequent, so a few turns of doubling do."""
    now = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        new = stage(now.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if not new.where("moved").take(1):
            return now


def spelling_variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """The forms of words ``word, n`` that look like misspellings of a far more frequent one.

    Returns a row per word: ``word, form, root, n, n_near, form_n``. Near words differ by
    exactly one inserted, deleted or replaced code point; ``n_near`` counts them. ``form`` is the
    most frequent near word, of equals the first in code-point order, if it occurs at least
    ``ratio`` times as often; ``root`` is where following forms ends, the word itself if it
    has none. Words are distinct, not null, and hold code points below 256 only.
    """
    words = stage(words.select("word", F.col("n").cast("long").alias("n")), "words")
    found = words.join(near_words(words, block), "word", "left")
    is_form = F.col("best_n") >= F.col("n") * ratio
    found = stage(
        found.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")),
        "forms",
    )
    ends = roots(found.where("form IS NOT NULL"))
    out = found.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO
) -> DataFrame:
    """Spelling variants among the words of all texts: see ``word_counts`` and ``spelling_variants``.

    Words of fewer than ``least_length`` code points or ``least_count`` occurrences do not
    take part. Null and empty texts have no words; each of several rows of an id counts; a null
    id is written as nothing where slips are drawn. No rows give no rows; other columns are
    ignored, whatever their names.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spelling_variants(word_counts(own, slips, least_length).where(F.col("n") >= least_count), ratio)
