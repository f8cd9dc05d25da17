"""Benchmark decontamination by the CGK random-walk embedding and bit-sampling LSH.

The CGK embedding walks over a string: at each step it writes down the symbol it stands on, and a
random bit, drawn for that step and symbol, says whether it moves on. Two strings at a small edit
distance walk together again after each edit, so their embeddings are at a small Hamming distance.
Sampled coordinates of the embedding are then an LSH key: windows with equal keys are candidates.

Windows begin at every word of every text, behind quotes and brackets too, and at every character of
scripts without spaces; in items likewise, as far as a whole window fits. An embedding of a whole
item would differ in too many coordinates, so a window is the part of an item that its length class
says: 36 steps for long items down to the whole of the shortest. Repetitions with other random bits
and coordinates raise the recall. Their number is found for each class from its items: they are
edited at random up to the accepted distance, and repetitions are added until the target recall is
reached; a class that does not get there gets shorter windows. Each candidate is verified by the
exact edit distance between the whole item and the item-sized stretch of the text.

Texts are compared with A-Z in lower case and each run of white space as one space. Nothing is
shuffled: the texts are scanned once for each block of items, and a block is bounded in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import col, flat, lower, mix, pieces, ranges, row_key

#: Accepted edit distance: at most (1 - SIMILARITY) x the item's length in bytes.
SIMILARITY = 0.8
TARGET_RECALL = 0.95
#: Steps of the walk over a window, at most (a multiple of STRIDE).
STEPS = 36
#: From so many bytes of an item on: steps of its windows, and coordinates in a key. The walk moves on
#: at every other step, so a window sees half as many bytes.
PLANS = ((180, 36, 9), (90, 24, 8), (50, 24, 6), (30, 15, 5), (12, 12, 4), (9, 9, 3), (6, 6, 2), (3, 3, 1))
#: Steps that one table look-up takes: the walk sees at most as many symbols.
STRIDE = 3
#: Bytes of benchmark text in one block; its keys take some ten times as much.
BLOCK_BYTES = 1 << 20
#: Edited items by which a class's recall is measured, and repetitions that are tried before its windows
#: are made shorter.
TRIALS, TRIED = 400, 24
#: Windows of the texts, and pairs of a window and an item, that are in hand at once.
STARTS, PAIRS = 1 << 16, 1 << 18
#: Symbols that the quick bound compares for one candidate; longer items are verified at once.
MOST_COMPARED = 1 << 22
SEED = 20240229


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with single spaces, none at the ends; their offsets; their old positions."""
    data = lower(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    keep = ~space
    if len(data):
        # One space before each word but the first of a text.
        keep[:-1] |= space[:-1] & ~space[1:] & ~begins[1:-1]
        word = np.flatnonzero(~space)
        first = np.searchsorted(word, offsets[:-1])
        some = first < len(word)
        first_word = np.full(len(offsets) - 1, len(data))
        first_word[some] = word[first[some]]
        for_text = np.repeat(first_word, np.diff(offsets))
        keep &= np.arange(len(data)) >= for_text
    position = np.flatnonzero(keep)
    return np.where(space, np.uint8(32), data)[position], np.searchsorted(position, offsets), position


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The symbol, 0 to 31, of each byte: space, a-z, digits, punctuation; bytes beyond ASCII by their last bits."""
    out = np.full(256, 28, np.uint16)
    out[32] = 0
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[ord("0") : ord("9") + 1] = 27
    out[128:] = np.arange(128) % 32  # other scripts' bytes share the symbols of a-z
    return out


def symbols(data: np.ndarray) -> np.ndarray:
    """For each position the codes of STRIDE symbols from there on, packed; some padding at the end."""
    code = np.concatenate([_classes()[data], np.zeros(STEPS + STRIDE, np.uint16)])
    packed = code.copy()
    for k in range(1, STRIDE):
        packed[:-k] |= code[k:] << np.uint16(5 * k)
    return packed


@lru_cache(maxsize=TRIED)
def _walk(repetition: int) -> tuple[np.ndarray, ...]:
    """For each look-up: how far the walk gets in STRIDE steps, by the packed symbols it sees."""
    bits = np.random.default_rng([SEED, repetition]).integers(0, 2, (STEPS, 32), dtype=np.uint8)
    code = np.arange(1 << (5 * STRIDE))
    tables = []
    for first in range(0, STEPS, STRIDE):
        at = np.zeros(len(code), np.uint8)
        for step in range(first, first + STRIDE):
            at += bits[step][(code >> (5 * at)) & 31]
        tables.append(at)
    return tuple(tables)


Plan = tuple[int, int]


@lru_cache(maxsize=1024)
def _sampled(repetition: int, plan: Plan) -> frozenset[int]:
    rng = np.random.default_rng([SEED, repetition, *plan])
    return frozenset(rng.choice(plan[0] // STRIDE, plan[1], replace=False).tolist())


def plan_of(length: int) -> Plan | None:
    """Steps and coordinates for an item of so many bytes; None for one that is too short to find."""
    return next(((steps, sampled) for least, steps, sampled in PLANS if length >= least), None)


def keys(packed: np.ndarray, starts: np.ndarray, repetition: int, plans: list[Plan]) -> dict[Plan, np.ndarray]:
    """The LSH key of the window at each start, for each plan."""
    at = starts.astype(np.int32)
    value = {p: np.full(len(at), p[0] + 1, np.uint64) for p in plans}
    most = max((steps for steps, _ in plans), default=0)
    for lookup, table in enumerate(_walk(repetition)[: most // STRIDE]):
        seen = packed[at]
        for p in plans:
            if lookup < p[0] // STRIDE and lookup in _sampled(repetition, p):
                value[p] = value[p] * np.uint64(37) + (seen & np.uint16(31))
        at = at + table[seen]
    return {p: mix(v + np.uint64(repetition << 40)) for p, v in value.items()}


def window_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where windows begin in normalised bytes.

    At each letter or digit behind another character, at each other character behind a space, at
    the begin of a text, and at every character of the scripts that write words without spaces:
    those with three bytes and more, but for the block of punctuation.
    """
    if not len(data):
        return np.empty(0, np.int64)
    letter = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    begins = (data >= 0xE0) & (data != 0xE2)
    begins[1:] |= (letter[1:] & ~letter[:-1]) | ((data[:-1] == 32) & (data[1:] != 32))
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


def edit_ends(item: bytes, text: bytes) -> np.ndarray:
    """The least edit distance of ``item`` to any stretch of ``text`` that ends before each position."""
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    out = np.empty(len(text) + 1, np.int32)
    out[0] = score
    for j, c in enumerate(text):
        match = masks.get(c, 0)
        x = match | down
        d = ((((x & up) + up) ^ up) | x) & full
        right, left = down | ~(d | up) & full, up & d
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = right << 1 & full
        up, down = (left << 1 & full) | ~(d | right) & full, right & d
        out[j + 1] = score
    return out


def best_stretch(item: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(distance, begin, end) of the stretch of ``text`` nearest to ``item``, if within ``most``."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    ends = edit_ends(item, text)
    end = int(np.argmin(ends))
    if ends[end] > most:
        return None
    begins = edit_ends(item[::-1], text[:end][::-1])
    return int(ends[end]), end - int(np.argmin(begins)), end


@dataclass(frozen=True)
class Index:
    """LSH keys of a block of items: for each repetition and plan, sorted, with item and offset."""

    ids: list
    items: list[bytes]
    similarity: float
    tables: list[dict[Plan, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


def slack_of(items: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edits that each item may have, and the cell that places of windows are rounded down to.

    Windows of one item with equal keys in one cell are one, on either side, so a text that repeats
    itself gives no more candidates than it has cells.
    """
    slack = ((1 - similarity) * np.array([len(x) for x in items]) + 1e-9).astype(np.int64)
    return slack, np.maximum(slack // 8, 1)


def _item_windows(items: list[bytes], plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, offset in the item, position in all items' bytes) of every window."""
    ends = np.cumsum([len(x) for x in items])
    starts = window_starts(np.frombuffer(b"".join(items), np.uint8), np.concatenate([[0], ends]))
    item = np.searchsorted(ends, starts, "right")
    fits = starts + plan[0] <= ends[item]
    item, starts = item[fits], starts[fits]
    return item, starts - (ends[item] - np.array([len(x) for x in items])[item]), starts


def _packed_items(items: list[bytes]) -> np.ndarray:
    return symbols(np.frombuffer(b"".join(items), np.uint8))


def _edited(item: bytes, edits: int, rng: np.random.Generator) -> bytes:
    out = bytearray(item)
    for _ in range(edits):
        at, kind = int(rng.integers(0, len(out))), int(rng.integers(0, 3))
        letter = int(rng.integers(ord("a"), ord("z") + 1))
        if kind == 0:
            out[at] = letter
        elif kind == 1:
            out.insert(at, letter)
        elif len(out) > 1:
            del out[at]
    return bytes(out)


def recall_by_repetitions(items: list[bytes], plan: Plan, similarity: float, trials: int, repetitions: int) -> np.ndarray:
    """The share of edited items that 1, 2, ... repetitions find.

    The items (each of them, as far as there are trials) get as many edits as are accepted, of single
    bytes at random places, the hardest kind: edits of whole words leave longer stretches as they are.
    """
    rng = np.random.default_rng(SEED)
    chosen = [items[int(i)] for i in np.linspace(0, len(items) - 1, trials)]
    edited = [_edited(x, int((1 - similarity) * len(x) + 1e-9), rng) for x in chosen]
    mine, theirs = _packed_items(chosen), _packed_items(edited)
    item, _, starts = _item_windows(chosen, plan)
    ends = np.cumsum([len(x) for x in edited])
    others = window_starts(np.frombuffer(b"".join(edited), np.uint8), np.concatenate([[0], ends]))
    of = np.searchsorted(ends, others, "right")
    found = np.zeros((trials, repetitions), bool)
    for r in range(repetitions):
        a, b = keys(mine, starts, r, [plan])[plan], keys(theirs, others, r, [plan])[plan]
        hit = np.isin(mix(a + item.astype(np.uint64)), mix(b + of.astype(np.uint64)))
        found[item[hit], r] = True
    return np.logical_or.accumulate(found, axis=1).mean(axis=0)


def repetitions_of(items: list[bytes], similarity: float = SIMILARITY, target: float = TARGET_RECALL) -> tuple[Plan, int]:
    """The plan for items of one class, and how many repetitions find this share of them.

    Shorter windows with fewer coordinates are tried where TRIED repetitions do not; the shortest
    that an item can have always end the search.
    """
    shortest = min(map(len, items))
    plans = [(steps, sampled) for least, steps, sampled in PLANS if shortest >= least]
    for plan in plans:
        recall = recall_by_repetitions(items, plan, similarity, TRIALS, TRIED)
        # Two standard errors above the target, so that chance does not choose too few.
        enough = np.flatnonzero(recall >= min(1.0, target + 2 * np.sqrt(target * (1 - target) / TRIALS)))
        if len(enough):
            return plan, int(enough[0]) + 1
    return plans[-1], TRIED


def build_index(ids: list, items: list[bytes], similarity: float, target: float) -> Index:
    classes: dict[Plan, list[int]] = {}
    for n, item in enumerate(items):
        if plan := plan_of(len(item)):
            classes.setdefault(plan, []).append(n)
    cells = slack_of(items, similarity)[1]
    tables: list[dict] = []
    for members in classes.values():
        mine = [items[n] for n in members]
        plan, repetitions = repetitions_of(mine, similarity, target)
        item, offset, position = _item_windows(mine, plan)
        item, packed = np.array(members)[item], _packed_items(mine)
        tables += [{} for _ in range(repetitions - len(tables))]
        for r in range(repetitions):
            key = keys(packed, position, r, [plan])[plan]
            order = np.lexsort((offset, item, key))
            k, i, o = key[order], item[order], offset[order]
            cell = o // cells[i]
            first = np.ones(len(k), bool)
            first[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (cell[1:] != cell[:-1])
            rows = (k[first], i[first].astype(np.int32), o[first].astype(np.int32))
            if plan in tables[r]:  # another class has come down to the same windows
                rows = tuple(np.concatenate(x) for x in zip(tables[r][plan][:3], rows))
                order = np.argsort(rows[0], kind="stable")
                rows = tuple(x[order] for x in rows)
            sieve = np.zeros(1 << 20, bool)
            sieve[rows[0] >> np.uint64(44)] = True
            tables[r][plan] = (*rows, np.packbits(sieve))
    return Index(ids, items, similarity, tables)


def candidates(index: Index, packed: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (item, where the item would begin, rounded down to its cell) that any repetition finds."""
    _, cells = slack_of(index.items, index.similarity)
    found = np.empty((0, 2), np.int64)
    for r, table in enumerate(index.tables):
        by_plan = keys(packed, starts, r, list(table))
        for plan, key in by_plan.items():
            sorted_keys, item, offset, sieve = table[plan]
            sieve = np.unpackbits(sieve).view(bool)
            maybe = np.flatnonzero(sieve[key >> np.uint64(44)])
            low = np.searchsorted(sorted_keys, key[maybe], "left")
            many = np.searchsorted(sorted_keys, key[maybe], "right") - low
            maybe, low, many = maybe[many > 0], low[many > 0], many[many > 0]
            if not len(many):
                continue
            # Of windows with one key in one of the smallest cells, the first.
            place = starts[maybe]
            smallest = int(cells[item].min())
            if smallest > 1:
                order = np.lexsort((place, low))
                a, b = low[order], place[order] // smallest
                first = order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])]
                place, low, many = place[first], low[first], many[first]
            upto = np.concatenate([[0], np.cumsum(many)])
            done = 0
            while done < len(many):
                last = max(done + 1, int(np.searchsorted(upto, upto[done] + PAIRS, "right")) - 1)
                at = ranges(low[done:last], many[done:last])
                begin = np.repeat(place[done:last], many[done:last]) - offset[at]
                cell = cells[item[at]]
                part = np.stack([item[at], begin // cell * cell], axis=1)
                found = _distinct(np.concatenate([found, _distinct(part)]))
                done = last
    return found


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The distinct rows of (item, begin), in order."""
    if not len(rows):
        return rows
    code = np.unique((rows[:, 0] << 40) + (rows[:, 1] + (1 << 39)))
    return np.stack([code >> 40, (code & ((1 << 40) - 1)) - (1 << 39)], axis=1)


#: Symbols in a gram of the quick bound.
GRAM = 4


def grams_of(packed: np.ndarray) -> np.ndarray:
    """The codes of GRAM symbols from each position on, from those of STRIDE."""
    more = packed.astype(np.int32)
    more[:-1] |= (more[1:] >> 10) << 15
    return more


def _enough_grams(grams: np.ndarray, packed: np.ndarray, begin: int, slack: int, wide: int) -> bool:
    """Whether enough of an item's grams occur near their places for at most ``slack`` edits.

    An edit spoils GRAM grams at most and shifts the rest by one, so this drops no true place.
    """
    least = len(grams) - GRAM * slack
    low, high = begin - wide, begin + wide + len(grams)
    if least <= 0 or low < 0 or high > len(packed) or len(grams) * (2 * wide + 1) > MOST_COMPARED:
        return True
    step = packed.itemsize
    near = np.ndarray((2 * wide + 1, len(grams)), packed.dtype, packed, low * step, (step, step))
    return int((near == grams).any(axis=0).sum()) >= least


def hits(index: Index, texts: pa.Array) -> list[tuple]:
    """(text number, item number, distance, begin, end) for each place of an item; bytes of the text."""
    raw, raw_offsets = flat(texts)
    data, offsets, position = normalised(raw, raw_offsets)
    starts = window_starts(data, offsets)
    if not len(starts) or not index.tables:
        return []
    packed = symbols(data)
    parts = (candidates(index, packed, starts[first : first + STARTS]) for first in range(0, len(starts), STARTS))
    grams = [grams_of(_packed_items([item]))[: max(0, len(item) - GRAM + 1)] for item in index.items]
    in_text = grams_of(packed)
    # A candidate's place lies in the text of its window; the begin that it computes may lie before.
    lengths = np.array([len(x) for x in index.items])
    slack, cells = slack_of(index.items, index.similarity)
    wide = slack + 3 * (cells - 1)  # the begin, the window and its place in the item are rounded down
    out, data_bytes = [], data.tobytes()
    groups: dict[tuple[int, int], list[list[int]]] = {}
    for item, begin in (row for part in parts for row in part.tolist()):
        n, extra = int(lengths[item]), int(wide[item])
        if not _enough_grams(grams[item], in_text, begin, int(slack[item]), extra):
            continue
        first = max(0, begin - extra)
        for text in range(
            max(0, int(np.searchsorted(offsets, first, "right")) - 1), min(len(offsets) - 1, int(np.searchsorted(offsets, begin + n + extra, "left")))
        ):
            low, high = max(first, int(offsets[text])), min(begin + n + extra, int(offsets[text + 1]))
            if high - low < n - int(slack[item]):
                continue
            places = groups.setdefault((text, item), [])
            if places and low <= places[-1][0] + 2 * extra:
                places[-1] = [min(places[-1][0], low), max(places[-1][1], high)]
            else:
                places.append([low, high])
    for (text, item), places in groups.items():
        stretches = []
        for low, high in places:
            if place := best_stretch(index.items[item], data_bytes[low:high], int(slack[item])):
                stretches.append((place[0], low + place[1], low + place[2]))
        # Neighbouring candidates may see one place, or an end of it: the nearest stretch counts.
        taken: list[tuple[int, int]] = []
        for distance, begin, end in sorted(stretches):
            if all(end <= a or b <= begin for a, b in taken):
                taken.append((begin, end))
                old_begin, old_end = position[begin], position[end - 1] + 1
                out.append((text, item, distance, int(old_begin - raw_offsets[text]), int(old_end - raw_offsets[text])))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list[bytes]]]:
    """The items in blocks of about ``block_bytes``; only one block is at the driver at a time."""
    rows = benchmark.select(col(id_col).alias("item_id"), col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = total // block_bytes + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for n in range(count):
        found = (rows if count == 1 else rows.filter(part == n)).collect()
        raw, offsets = flat(pa.array([text for _, text in found], pa.string()))
        data, offsets, _ = normalised(raw, offsets)
        whole = data.tobytes()
        yield [i for i, _ in found], [whole[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def find_items(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    target_recall: float = TARGET_RECALL,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Places of benchmark items: doc_id, item_id, distance, similarity, begin_byte, end_byte, row_key.

    A row for each place whose edit distance to a whole item is at most (1 - similarity) of the
    item's length; begin_byte and end_byte are UTF-8 bytes of the text as it is. Every text and every
    item takes part, whatever its length, and a text that repeats itself costs bounded memory; NULL and empty texts have no places, and items under three
    bytes are not searched for. Repeated rows and items each give their own rows; NULL identifiers
    are carried along; other columns are ignored. ``row_key`` tells the rows of ``df`` apart.
    """
    rows = df.select(
        col(id_col).alias("doc_id"),
        row_key(id_col, text_col).alias("row_key"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    item = benchmark.select(col(item_id_col).alias("item_id"))
    item_type = item.schema[0].dataType
    schema = T.StructType(
        [
            *rows.select("doc_id").schema,
            *item.schema,
            *T.StructType.fromDDL("distance int, similarity double, begin_byte bigint, end_byte bigint, row_key string"),
        ]
    )
    context = df.sparkSession.sparkContext
    result = None
    for ids, items in _blocks(benchmark, item_id_col, item_text_col, block_bytes):
        shared = context.broadcast(build_index(ids, items, similarity, target_recall))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            item_ids = pa.array(index.ids, to_arrow_type(item_type))
            for batch in pieces(batches):
                found = hits(index, batch.column("text"))
                if found:
                    text, item, distance, begin, end = (np.array(x) for x in zip(*found))
                    lengths = np.array([len(index.items[i]) for i in item])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(pa.array(text)),
                            item_ids.take(pa.array(item)),
                            pa.array(distance, pa.int32()),
                            pa.array(1 - distance / lengths),
                            pa.array(begin, pa.int64()),
                            pa.array(end, pa.int64()),
                            batch.column("row_key").take(pa.array(text)),
                        ],
                        schema.names,
                    )

        found = rows.mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    return result


def clean_rows(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    target_recall: float = TARGET_RECALL,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``df`` in which no benchmark item is found, with all their columns; repeats stay."""
    context, schema, names = df.sparkSession.sparkContext, df.schema, df.columns
    at = names.index(text_col)
    for ids, items in _blocks(benchmark, item_id_col, item_text_col, block_bytes):
        shared = context.broadcast(build_index(ids, items, similarity, target_recall))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, done = [], 0
                for piece in pieces(iter([pa.RecordBatch.from_arrays([batch.column(at)], ["text"])])):
                    found += [done + text for text, *_ in hits(shared.value, piece.column("text"))]
                    done += piece.num_rows
                clean = np.ones(batch.num_rows, bool)
                clean[found] = False
                yield batch.filter(pa.array(clean))

        df = df.mapInArrow(run, schema)
    return df
