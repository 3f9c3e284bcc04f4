"""Coefficients of sequential JPEG scans, read at thousands of places at once.

Where a code begins depends on all codes before it, but a reader that begins anywhere mostly falls into step after some codes. So
the data are cut into stretches that are read side by side, each from where a reader comes that begins some way before it. A stretch
that was not begun where the one before it ended is read again from there, until none is left: then all were begun rightly,
whatever had been guessed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Bits of a stretch and of the way before it; stretches side by side; steps between looks at which still go on; rounds, and wrong
#: stretches, before what is left is followed code by code; blocks that are made at once. No effect on results.
STRETCH, LEAD, STRETCHES, STEPS, ROUNDS, FEW, BLOCKS = 2048, 1024, 4096, 16, 12, 64, 2**16
# Fixed values of the format: the zigzag order (diagonal by diagonal, upwards and downwards in turn); a run of sixteen zeros.
ZIGZAG = [8 * (d - x) + x for d in range(15) for x in sorted(range(max(0, d - 7), min(7, d) + 1), reverse=d % 2 == 1)]
ZEROS = 0xF0
_PLACES = np.array(ZIGZAG + [0] * 64)
_NEVER = np.iinfo(np.int64).max
_ONES = (1 << np.arange(16)) - 1


class Unreadable(ValueError):
    """The file breaks its format."""


class Unread(ValueError):
    """The file's form is not read here."""


Codes = tuple[bytes, bytes]  # how many there are of each length, and their values


class Part(NamedTuple):
    """Coded data between restarts. units: per block the codes of its first coefficient and of the others, over and over again."""

    data: bytes
    units: tuple[tuple[Codes, Codes], ...]
    blocks: int


@functools.lru_cache(64)
def lookup(counts: bytes, values: bytes) -> np.ndarray:
    """By the next 16 bits: the code's length << 8 | its value; 0 where no code begins so."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for length, count in enumerate(counts, 1):
        for value in values[at : at + count]:
            first, upto = code << 16 - length, code + 1 << 16 - length
            if upto > 1 << 16:
                raise Unreadable("more codes than there can be")
            table[first:upto] = length << 8 | value
            code += 1
        at += count
        code <<= 1
    return table


@functools.lru_cache(64)
def steps(codes: Codes, others: bool) -> np.ndarray:
    """By the next 16 bits: bits to go on | coefficients to go on << 5 | size of the value << 12. No coefficients: no such code (one
    bit on, so that a guess may come right); 64: the block ends. others: codes of all but the first coefficient."""
    found = lookup(*codes)
    length, value = found >> 8, found & 255
    size = value & 15 if others else value
    on = np.where(size > 0, (value >> 4) + 1, np.where(value == ZEROS, 16, 64)) if others else np.ones_like(value)
    made = length + size | on << 5 | size << 12
    return np.where((length == 0) | (size > 15), 1, made).astype(np.uint16)


class Tables:
    """The steps of all codes of some parts, and per state (block of a unit * 128 + next coefficient) whose turn it is."""

    def __init__(self, parts: list[Part]):
        kinds = {key: i for i, key in enumerate(dict.fromkeys((codes, i > 0) for units in {p.units for p in parts} for pair in units for i, codes in enumerate(pair)))}
        self.step = np.concatenate([steps(*key) for key in kinds]) if kinds else np.zeros(0, np.uint16)
        first, after, self.begin = [], [], {}
        for units in dict.fromkeys(p.units for p in parts):
            self.begin[units] = begin = 128 * len(first)
            for i, (dc, ac) in enumerate(units):
                table = np.full(128, kinds[ac, True] << 16)
                table[0] = kinds[dc, False] << 16
                first.append(table)
                state = begin + 128 * i + np.arange(128)
                state[64:] = begin + 128 * ((i + 1) % len(units))
                after.append(state)
        self.first, self.after = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, after))

    def read(self, window: np.ndarray, at: np.ndarray, state: np.ndarray, end: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """From bits and states on, each as long as before its end: bit and state. kept takes what was found: which ones, and by step
        and by these the bit, the state and the step (0: none)."""
        which = np.arange(len(at))
        left = at.copy(), state.copy()
        while len(which):
            seen = []
            for _ in range(STEPS):
                step = self.step[self.first[state] + (window[at >> 3] >> 16 - (at & 7) & 0xFFFF)] * (at < end)
                if kept is not None:
                    seen.append((at, state, step))
                at = at + (step & 31)
                state = self.after[state + (step >> 5 & 127)]
            if kept is not None:
                kept.append((which, *(np.stack(x) for x in zip(*seen))))
            goes_on = at < end
            if np.count_nonzero(goes_on) < 0.75 * len(which):
                for whole, now in zip(left, (at, state)):
                    whole[which] = now
                which, at, state, end = (x[goes_on] for x in (which, at, state, end))
        return left

    def walk(self, window: np.ndarray, at: int, state: int, end: int) -> tuple[int, int]:
        """The same for one, code by code."""
        step, window, first, after = map(memoryview, (self.step, window, self.first, self.after))
        while at < end:
            found = step[first[state] + (window[at >> 3] >> 16 - (at & 7) & 0xFFFF)]
            at, state = at + (found & 31), after[state + (found >> 5 & 127)]
        return at, state


def windows(data: np.ndarray) -> np.ndarray:
    """32 bits from every byte on."""
    part = np.concatenate([data, np.zeros(12, np.uint8)]).astype(np.uint32)
    return part[:-3] << 24 | part[1:-2] << 16 | part[2:-1] << 8 | part[3:]


def settled(tables: Tables, window: np.ndarray, at: np.ndarray, state: np.ndarray, end: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Reads stretches that begin where given, but for those that don't begin a part, where the one before ends. Bits and states at
    their ends, and what was found."""
    kept: list = []
    out_at, out_state = tables.read(window, at, state, end, kept)

    def again(some: np.ndarray) -> None:
        gone = np.zeros(len(at), bool)
        gone[some] = True
        for which, *_, step in kept:
            step[:, gone[which]] = 0
        new: list = []
        out_at[some], out_state[some] = tables.read(window, at[some], state[some], end[some], new)
        kept.extend((some[which], *rest) for which, *rest in new)

    def wrongly_begun() -> np.ndarray:
        return 1 + np.flatnonzero(~begins[1:] & ((at[1:] != out_at[:-1]) | (state[1:] != out_state[:-1])))

    before = len(at)
    for tried in range(ROUNDS):
        wrong = wrongly_begun()
        if len(wrong) <= FEW or tried > 1 and len(wrong) > 0.75 * before:  # readers don't fall into step
            break
        before = len(wrong)
        at[wrong], state[wrong] = out_at[wrong - 1], out_state[wrong - 1]
        again(wrong)
    changed = []
    for i in wrongly_begun().tolist():
        while i < len(at) and not begins[i] and (at[i] != out_at[i - 1] or state[i] != out_state[i - 1]):
            at[i], state[i] = out_at[i - 1], out_state[i - 1]
            out_at[i], out_state[i] = tables.walk(window, int(at[i]), int(state[i]), int(end[i]))
            changed.append(i)
            i += 1
    if changed:
        again(np.unique(changed))
    return out_at, out_state, kept


def decoded(parts: list[Part]) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of all parts, numbered through: the first one's number, and 64 coefficients of each in natural order (the first as its
    difference). From a place on where a part is broken, its blocks are missing."""
    if not parts:
        return
    tables = Tables(parts)
    bits = np.array([8 * len(p.data) for p in parts])
    most = np.array([p.blocks for p in parts])
    row = np.cumsum(most) - most
    offset = np.cumsum(bits + 64) - bits - 64  # each part is followed by 8 bytes of zeros
    data = np.frombuffer(b"".join(x for p in parts for x in (p.data, bytes(8))), np.uint8)
    count = np.maximum(1, -(-bits // STRETCH))
    part = np.repeat(np.arange(len(parts)), count)
    number = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
    start = offset[part] + STRETCH * number
    last = offset + bits
    end = np.minimum(start + STRETCH, last[part])
    initial = np.array([tables.begin[p.units] for p in parts])[part]
    done = np.zeros(len(parts), np.int64)  # blocks of each part that have ended
    fine = np.ones(len(parts), bool)
    out_at = out_state = np.zeros(0, np.int64)
    rest = np.zeros(64, np.int16)  # what is there of a block that has not ended
    for a in range(0, len(part), STRETCHES):
        of, begins = part[a : a + STRETCHES], number[a : a + STRETCHES] == 0
        here = start[a : a + STRETCHES]
        base = (int(here[0]) - LEAD >> 3 << 3) if a else 0
        window = windows(data[base >> 3 : (int(end[a : a + STRETCHES].max()) >> 3) + 8])
        here, upto = here - base, end[a : a + STRETCHES] - base
        lead = np.where(begins, here, here - LEAD)
        at, state = tables.read(window, lead, initial[a : a + STRETCHES] + ~begins, here)  # as if in a block
        if not begins[0]:
            at[0], state[0] = out_at[-1], out_state[-1]
            at[0] -= base
        out_at, out_state, kept = settled(tables, window, at, state, upto, begins)
        out_at = out_at + base
        kept = [(which, *found, (found[1] + (found[2] >> 5 & 127) >> 6 & 1).astype(np.uint8)) for which, *found in kept]
        blocks = np.zeros(len(of), np.int64)
        for which, *_, ends in kept:
            blocks[which] += ends.sum(axis=0, dtype=np.int64)
        before = np.cumsum(blocks) - blocks
        heads = np.maximum.accumulate(np.where(np.append(True, begins[1:]), np.arange(len(of)), 0))
        before += done[of] - before[heads]
        np.add.at(done, of, blocks)
        b = 0
        while b < len(of):
            c = b + max(1, int(np.searchsorted(np.cumsum(blocks[b:]), BLOCKS, side="right")))
            one = np.flatnonzero(np.append(True, of[b + 1 : c] != of[b : c - 1]))  # where parts begin among these stretches, and end
            two = np.append(one[1:], c - b) - 1
            mine = of[b:c][one]
            low = np.minimum(before[b:c][one], most[mine])
            high = np.minimum((before + blocks)[b:c][two], most[mine])
            place = np.cumsum(high - low + 1) - (high - low + 1)  # one more each, for a block that has not ended
            out = np.zeros((int(place[-1] + high[-1] - low[-1]) + 1, 64), np.int16)
            if not begins[b]:
                out[0] = rest
            n = two - one + 1
            bad = placed(out, kept, b, before[b:c].copy(), np.repeat(place - low, n), most[of[b:c]], (last - base)[of[b:c]], window)
            for i, k, p, q, r in zip(mine.tolist(), place.tolist(), low.tolist(), high.tolist(), np.minimum.reduceat(bad, one).tolist()):
                if fine[i] and min(q, r) > p:
                    yield int(row[i]) + p, out[k : k + min(q, r) - p]
                fine[i] &= r == _NEVER
            rest = out[-1].copy()
            b = c


def placed(out: np.ndarray, kept: list, first: int, before: np.ndarray, shift: np.ndarray, most: np.ndarray, last: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Puts what was read into its blocks, of stretches from first on. before, shift, most, last: per stretch its blocks' first number,
    what is added to a number for the place in out, how many blocks its part has and where that ends. Returns the number of its
    first broken block."""
    bad = np.full(len(before), _NEVER)
    for which, *found in kept:
        some = slice(*np.searchsorted(which, [first, first + len(before)]))
        which, (at, state, step, ends) = which[some] - first, (x[:, some] for x in found)
        if not len(which):
            continue
        number = np.cumsum(ends, axis=0, dtype=np.int64)
        total = number[-1].copy()
        number += before[which]
        before[which] += total
        number -= ends
        lines, columns = np.nonzero((step > 0xFFF) & (number < most[which]))  # values
        each = lines * len(which) + columns
        has, k, bit, row = (x.reshape(-1)[each] for x in (step, state, at, number + shift[which]))
        size = (has >> 12).astype(np.int64)
        place = (k & 127) + (has >> 5 & 127) - 1
        from_ = bit + (has & 31) - size
        ones = _ONES[size]
        v = window[from_ >> 3] >> 32 - (from_ & 7) - size & ones
        out.reshape(-1)[row * 64 + _PLACES[place]] = v - (v <= ones >> 1) * ones
        # what may be wrong: no such code, too many coefficients, beyond the end
        for lines, columns in ((step == 1) & (number < most[which])).nonzero(), (x[place > 63] for x in (lines, columns)):
            np.minimum.at(bad, which[columns], number[lines, columns])
        late = np.flatnonzero(at[-1] + (step[-1] & 31) > last[which])
        lines, columns = np.nonzero((step[:, late] != 0) & (number[:, late] < most[which[late]]) & (at[:, late] + (step[:, late] & 31) > last[which[late]]))
        np.minimum.at(bad, which[late[columns]], number[lines, late[columns]])
    return bad
