"""Token ids of whole texts with each distinct piece of text encoded once.

A tokenizer's own pre-tokenisation never joins what stands before a single space or line
break with what follows it, when neither neighbour is white space. So a text may be cut there and the ids of
the cuts be concatenated. Natural text repeats its pieces: a dictionary of pieces already
encoded turns most of the work into look-ups, and only new pieces reach the library.
"""

from __future__ import annotations

import json
import string
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.workers import held, values

#: Words and other pieces that a worker keeps (some 150 bytes each); beyond it those met once make room.
CACHE_PIECES = 500_000
#: Longer pieces are encoded but not kept.
KEEP_CHARS = 48
#: Words of the Latin letters below U+0130, whose lower case is one letter each.
LATIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+$"
#: Marks that never join a word before them; a run of them at a piece's end is a pre-token.
MARKS = string.punctuation


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte, as byte-level BPE vocabularies write it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()
#: Those beyond ASCII; the letters of ASCII stand for themselves.
HIGH_CHARS = {b: c for b, c in BYTE_CHARS.items() if b > 127}


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Merges:
    """Byte-pair merges of many short words at once, one merge of each in a step.

    The least rank of a word goes first, the leftmost of equals, as in the library. A merge's symbol
    takes the place of its left part, and places are linked, so that a step costs the same at any length.
    """

    #: Symbols of a word at most; longer words are left to the library. Words of about a length go together, so many at a time.
    LIMIT, LENGTHS, WORDS = 32, (6, 10, 16, 32), 1 << 14
    PAD, NONE = np.uint32(0xFFFF), np.int32(2**31 - 1)

    def __init__(self, mid: np.ndarray, last: np.ndarray, lead: int | None, pairs: np.ndarray, made: np.ndarray):
        self.mid, self.last, self.lead, self.made = mid, last, lead, made
        bits = max(10, int(4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        # Open addressing; a key of two PADs is an empty slot.
        self.keys, self.ranks = np.full(1 << bits, 0xFFFFFFFF, np.uint32), np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(pairs)), self._slot(pairs)
        while len(todo):
            free = self.keys[slot[todo]] == 0xFFFFFFFF
            self.ranks[slot[todo[free]]] = todo[free]
            won = todo[free][self.ranks[slot[todo[free]]] == todo[free]]
            self.keys[slot[won]] = pairs[won]
            todo = np.setdiff1d(todo, won)
            slot[todo] = (slot[todo] + 1) & self.mask

    @classmethod
    def of(cls, spec: dict, lead: str):
        """None unless every byte has a symbol and no two merges give one token, as then order is by rank alone."""
        vocab, suffix = spec["vocab"], spec.get("end_of_word_suffix") or ""
        if spec.get("ignore_merges") or spec.get("continuing_subword_prefix") or max(vocab.values()) >= cls.PAD:
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        mid, last = ([vocab.get(BYTE_CHARS[b] + x) for b in range(256)] for x in ("", suffix))
        made = [vocab.get(a + b) for a, b in pairs]
        if None in mid or None in last or None in made or len(set(made)) < len(made) or (lead and lead not in vocab):
            return None
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        return cls(np.array(mid, np.uint32), np.array(last, np.uint32), vocab[lead] if lead else None, keys, np.array(made, np.uint32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1) >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's rank, or -1."""
        keys = left << np.uint32(16) | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found != 0xFFFFFFFF))
        while len(todo):
            at = slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit & (found != 0xFFFFFFFF)]
        return out

    def _order(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        rank = self._rank(left, right)
        return np.where(rank < 0, self.NONE, rank * np.int32(self.LIMIT) + place.astype(np.int32))

    def __call__(self, words: list[str]):
        """Yields numbers of words with their ids, laid end to end, and how many each has; then those of words that are too long, with nothing."""
        data = np.frombuffer("\n".join(words).encode(), np.uint8)
        ends = np.append(np.flatnonzero(data == 10), len(data))
        starts = np.concatenate([[0], ends[:-1] + 1])
        size = ends - starts + (self.lead is not None)
        low = 0
        for high in self.LENGTHS:
            some = np.flatnonzero((size > low) & (size <= high))
            low = high
            for at in range(0, len(some), self.WORDS):
                part = some[at : at + self.WORDS]
                yield (part, *self._merge(data, starts[part], ends[part], high))
        yield np.flatnonzero(size > low), None, None

    def _merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        n, k, first = ends - starts, len(starts), int(self.lead is not None)
        # A row a place, a column a word; the row after the last stands for what is before and behind a word.
        symbols = np.full((rows + 1, k), self.PAD, np.uint32)
        if first:
            symbols[0] = self.lead
        at = starts + np.arange(rows - first)[:, None]
        symbols[first:rows] = np.where(at < ends, self.mid[data[np.minimum(at, len(data) - 1)]], self.PAD)
        symbols[first + n - 1, np.arange(k)] = self.last[data[ends - 1]]
        order = np.full((rows + 1, k), self.NONE, np.int32)
        order[: rows - 1] = self._order(symbols[: rows - 1].ravel(), symbols[1:rows].ravel(), np.repeat(np.arange(rows - 1), k)).reshape(-1, k)
        behind = np.repeat(np.arange(1, rows + 2, dtype=np.int32)[:, None], k, axis=1)
        before = np.repeat(np.arange(-1, rows, dtype=np.int32)[:, None], k, axis=1)
        before[0] = rows
        flat, ranked, behind, before = symbols.ravel(), order.ravel(), behind.ravel(), before.ravel()
        while True:
            best = order.min(axis=0)
            word = np.flatnonzero(best != self.NONE)
            if not len(word):
                break
            best = best[word]
            place = best & (self.LIMIT - 1)
            here = place * k + word
            gone = behind[here] * k + word
            after, ahead = behind[gone], before[here]
            flat[here], flat[gone], ranked[gone] = self.made[best // self.LIMIT], self.PAD, self.NONE
            behind[here], before[after * k + word] = after, place
            left, now = flat[ahead * k + word], flat[here]
            new = self._order(np.concatenate([now, left]), np.concatenate([flat[after * k + word], now]), np.concatenate([place, ahead]))
            ranked[here], ranked[ahead * k + word] = new[: len(word)], new[len(word) :]
        kept = symbols[:rows] != self.PAD
        return symbols[:rows].T[kept.T], kept.sum(axis=0)


class PieceEncoder:
    """The ids that the library gives with ``add_special_tokens=False``.

    Pieces are encoded apart for the two kinds of BPE tokenizers known to split at spaces. Whole
    texts go to the library if they hold an added token, a run of white space, or white space at an
    end, and all texts do for other tokenizers. Null is treated as the empty text, which has no ids.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_pieces = cache_pieces
        self.merges, self.lead, self.fold, self.added, self.short, self.drops = self._direct(path, self.tokenizer)
        self.widths = self._widths() if self.merges is not None else None
        self._reset()

    def _widths(self) -> np.ndarray:
        """Bytes of each token's text."""
        suffix = self.merges.model.end_of_word_suffix or ""
        out = np.zeros(max(self.merges.get_vocab().values()) + 1, np.int64)
        for token, i in self.merges.get_vocab().items():
            out[i] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)
        return out

    @staticmethod
    def _direct(path: str, tokenizer):
        """The merges alone, what stands before a word, whether letters are lower-cased, the
        added tokens, the merges of short words if they can be had, and whether a line break is read as a space;
        no merges if the tokenizer isn't of one of the two kinds that are known."""
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
            return None, "", False, (), None, False
        # Added tokens are looked for in the text as it stands, so that a text without one can be told.
        added = tuple(x["content"] for x in spec.get("added_tokens") or ())
        if any(norm and x.get("normalized") for x in spec.get("added_tokens") or ()):
            return None, "", False, (), None, False
        lower = bool(norm) and any(n["type"] == "Lowercase" for n in norm.get("normalizers", [norm]))
        byte_level = norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        word_ends = lower and bool(spec["model"].get("end_of_word_suffix")) and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
        if not (byte_level or word_ends):
            return None, "", False, (), None, False
        bare = Tokenizer(tokenizer.model)  # the same merges in memory
        bare.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        lead = "\u0120" if byte_level else ""
        drops = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} in (norm or {}).get("normalizers", [norm])
        return bare, lead, lower, added, Merges.of(spec["model"], lead), drops

    def _reset(self) -> None:
        self.index: dict[str | tuple, int] = {}  # words and other pieces; (marks,); ("", first piece)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.hits, self.n = np.zeros(1 << 12, np.int32), 0
        self._add([("",)], np.zeros(0, np.uint32), np.zeros(1, np.int64))  # number 0: nothing

    def _trim(self) -> None:
        """Keep the pieces that were met again, half of the limit at most."""
        hits = self.hits[: self.n]
        keep = hits > 1
        if keep.sum() > self.cache_pieces // 2:
            keep = hits > np.partition(hits, -(self.cache_pieces // 2))[-(self.cache_pieces // 2)]
        old = [(p, k) for p, k in self.index.items() if k > 0 and keep[k]]
        was = np.array([k for _, k in old], np.int64)
        ids, n = self._gather(was)
        hits = hits[was] // 2
        self._reset()
        if old:
            self._add([p for p, _ in old], ids.copy(), n)
            self.hits[1 : self.n] = hits

    def _add(self, keys: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keep the ids of ``keys``, laid end to end."""
        k, n = len(keys), len(ids)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + k > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.flat[self.used : self.used + n] = ids
        self.lengths[self.n : self.n + k] = lengths
        self.starts[self.n : self.n + k] = self.used + np.cumsum(lengths) - lengths
        self.index.update(zip(keys, range(self.n, self.n + k)))
        self.used += n
        self.n += k

    def _gather(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.lengths[k]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[k] - ends + n, n) + np.arange(total)], n

    def _add_encoded(self, keys: list, encoding) -> None:
        words = np.array(encoding.word_ids, np.float64)  # None becomes nan, which no key counts
        self._add(keys, np.array(encoding.ids, np.uint32), np.bincount(words[~np.isnan(words)].astype(np.int64), minlength=len(keys)))

    def _learn(self, words: list[str], pieces: list[str], marks: list[tuple], heads: list[tuple]) -> None:
        """Encode what is new. ``words`` are pre-tokens by themselves and go straight to the merges; others take the whole way."""
        index, rest, breaks = self.index, [], []
        if self.short and words:
            for some, ids, n in self.short(words):
                part = [words[i] for i in some.tolist()]
                if ids is None:
                    words = part
                else:
                    self._add(part, ids, n)
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            laid = "\n".join(part)
            if not laid.isascii():
                laid = laid.encode().decode("latin-1").translate(HIGH_CHARS)
            if self.lead:
                laid = self.lead + laid.replace("\n", "\n" + self.lead)
            ids = np.array(self.merges.encode_batch_fast([laid], add_special_tokens=False)[0].ids, np.uint32)
            # The tokens' widths say where each word ends: at the line breaks, which have no token.
            breaks_at = np.flatnonzero(np.frombuffer(laid.encode("utf-32-le"), np.uint32) == 10)
            ends = np.searchsorted(np.cumsum(self.widths[ids]), np.append(breaks_at - np.arange(len(breaks_at)), len(laid) - len(breaks_at))) + 1
            self._add(part, ids, np.diff(ends, prepend=0))
        for p in pieces:
            if not p or p[-1].isspace():
                index[p] = -1
            elif not p[0].isspace():
                rest.append(p)
            elif p[0] == "\n" and not p[1].isspace():
                breaks.append(p)
            else:
                index[p] = -1
        for h in heads:
            if not h[1] or h[1][0].isspace() or h[1][-1].isspace():
                index[h] = -1
        heads = [h for h in heads if h not in index]
        for keys, texts in ((rest, [" " + p for p in rest]), (breaks, breaks), (marks, [m[0] for m in marks]), (heads, [h[1] for h in heads])):
            for at in range(0, len(keys), 1000):
                self._add_encoded(keys[at : at + 1000], self.tokenizer.encode(texts[at : at + 1000], add_special_tokens=False, is_pretokenized=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """An array of ids (uint32) for each text."""
        if self.merges is None:
            return [self._whole(t) for t in texts]
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and size < 1 << 21:  # about two million characters at a time
                size += len(texts[stop] or "")
                stop += 1
            out.extend(self._encode(texts[at:stop]))
            at = stop
        return out

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > self.cache_pieces:
            self._trim()
        low = [t.lower() if t and (t.isascii() or _latin(t)) else t for t in texts] if self.fold else texts
        # A text with an added token, or with one once lower-cased, goes to the library as it stands.
        special = {i: t for i, (t, u) in enumerate(zip(texts, low)) if t and any(x in t or x in u for x in self.added)}
        texts = ["" if i in special else u for i, u in enumerate(low)] if special else low
        # A single line break between words begins a piece of its own, as no pre-token spans it, or is as good as a space.
        line = " " if self.drops else " \n"
        cut = pc.split_pattern(pa.array([t.replace("\n", line) if t else "" for t in texts], pa.large_string()), " ")
        # Arrow numbers the different pieces, and the different words in them, so that each is looked up once.
        coded = cut.flatten().dictionary_encode()
        code, found = coded.indices.to_numpy(), coded.dictionary
        bounds = cut.offsets.to_numpy()
        # A Latin word, alone or before marks, is a pre-token by itself. The merges don't lower-case, so
        # that capitals (of texts beyond Latin-1) take the whole way.
        cores = pc.ascii_rtrim(found, MARKS)
        word = pc.ascii_is_alpha(cores).to_numpy(zero_copy_only=False) & pc.string_is_ascii(cores).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~word & ~pc.string_is_ascii(cores).to_numpy(zero_copy_only=False))
        if len(other):
            word[other] = pc.match_substring_regex(cores.take(pa.array(other)), LATIN).to_numpy(zero_copy_only=False)
        if self.fold:
            word &= pc.equal(pc.utf8_lower(cores), cores).to_numpy(zero_copy_only=False)
        looked = pc.if_else(pa.array(word), cores, found).dictionary_encode()
        key_of, keys = looked.indices.to_numpy(), values(looked.dictionary)
        is_word = np.zeros(len(keys), bool)
        is_word[key_of] = word
        size, core_size = pc.binary_length(found).to_numpy(), pc.binary_length(cores).to_numpy()
        tail = np.flatnonzero(word & (core_size < size))
        tails = _ends_of(found, tail, (size - core_size)[tail]).dictionary_encode()
        marks = [(m,) for m in values(tails.dictionary)]
        # The first piece has no space before it, which matters to byte-level tokenizers.
        heads = [("", p) for p in values(found.take(pa.array(code[bounds[:-1]])))] if self.lead else []
        k = np.fromiter(map(self.index.get, keys, repeat(-2)), np.int64, len(keys))
        missing = np.flatnonzero(k == -2)
        lost = lambda some: [x for x in dict.fromkeys(some) if x not in self.index]
        absent, new = [keys[i] for i in missing.tolist()], is_word[missing].tolist()
        self._learn([x for x, w in zip(absent, new) if w], [x for x, w in zip(absent, new) if not w], lost(marks), lost(heads))
        k[missing] = np.fromiter(map(self.index.__getitem__, absent), np.int64, len(absent))
        known = k >= 0
        self.hits[k[known]] += np.bincount(key_of, np.bincount(code, minlength=len(found)), len(k))[known].astype(np.int32)
        k = k[key_of]
        # The ids of each different piece: its word's and its marks'; then of each different head.
        after = np.zeros(len(k), np.int64)
        after[tail] = np.array([self.index[m] for m in marks], np.int64)[tails.indices.to_numpy()]
        at_head = np.array([self.index[h] for h in heads], np.int64)
        first = np.concatenate([k, at_head])
        after = np.concatenate([after, np.zeros(len(at_head), np.int64)])
        safe = first >= 0
        table, n = self._gather(np.stack([np.where(safe, first, 0), np.where(safe, after, 0)], axis=1).ravel())
        n = n.reshape(-1, 2).sum(1)
        starts = np.cumsum(n) - n
        for x in {x for x in absent if len(x) > KEEP_CHARS} | {m for m in marks if len(m[0]) > KEEP_CHARS} | {h for h in heads if len(h[1]) > KEEP_CHARS}:
            del self.index[x]
        if self.lead:
            code = code.copy()
            code[bounds[:-1]] = len(k) + np.arange(len(heads))
        at, n = starts[code], n[code]
        ends = np.cumsum(n)
        ids = table[np.repeat(at - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        stops = np.concatenate([[0], ends])[bounds].tolist()
        unsafe = np.concatenate([[0], np.cumsum(~safe[code])])[bounds].tolist()
        out = []
        for i, t in enumerate(texts):
            if not t:
                out.append(self._whole(special.get(i)))
            elif unsafe[i + 1] > unsafe[i]:
                out.append(self._whole(t))
            else:
                out.append(ids[stops[i] : stops[i + 1]])
        return out

    def _whole(self, text: str | None) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids if text else [], np.uint32)


def _ends_of(texts: pa.Array, which: np.ndarray, n: np.ndarray) -> pa.Array:
    """The last ``n`` bytes of some texts (large_string)."""
    _, offsets, data = texts.buffers()
    stop = np.frombuffer(offsets, np.int64)[texts.offset + 1 + which]
    ends = np.cumsum(n.astype(np.int64))
    flat = np.frombuffer(data, np.uint8)[np.repeat(stop - ends, n) + np.arange(int(ends[-1]) if len(ends) else 0)] if data else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(flat)])


def encoder(path: str) -> PieceEncoder:
    """One encoder for a worker's tasks."""
    return held(f"encoder {path}", lambda: PieceEncoder(path))


def parts(batch, column: int, size: int = 4 << 20):
    """Slices of an Arrow batch whose texts have about ``size`` bytes together, so that what is made of a slice stays small."""
    n = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64)))
    start = 0
    while start < batch.num_rows:
        done = n[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(n, done + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
