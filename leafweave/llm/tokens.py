"""Fast exact encoding with a byte-level BPE of the tokenizers library.

A byte-level BPE first cuts a text into pieces by its pattern and encodes each
piece on its own.  A text can therefore be cut beforehand wherever the pattern
surely cuts it too, and equal chunks encoded once.  Chunks are found by numpy;
the library encodes each distinct one; a bounded memo keeps its ids.

Sure cuts are (a) before ASCII white space that follows a visible character
and (b) before ASCII punctuation other than an apostrophe that follows a
letter.  "Visible" and "letter" are decided by bytes, and only for ASCII and
two-byte characters; elsewhere the text stays in one chunk, which is slower,
never different.
"""

from __future__ import annotations

import os

import numpy as np

from leafweave.llm import textkit as tk

#: The memo is emptied when it holds so many distinct chunks.
MEMO_CHUNKS = 3_000_000
#: Chunks of so many bytes or more aren't hashed; each is encoded on its own.
LONG_CHUNK = 256

_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[0x41:0x5B] = _ALPHA[0x61:0x7B] = True
_PUNCT = _VISIBLE & ~_ALPHA
_PUNCT[0x30:0x3A] = False
_PUNCT[0x27] = False
#: Lead bytes of two-byte characters from U+00C0 on: none of them is white space.
_LEAD2 = np.zeros(256, dtype=bool)
_LEAD2[0xC3:0xE0] = True


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        #: As the file defines it, for texts with an added token such as an end mark.
        self.plain = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.plain.get_added_tokens_decoder().values() if t.content]
        #: For chunks of all other texts; chunks that are joined by chance must not form an added token.
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        #: The smallest unsigned type that holds every id.
        self.dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.token_bytes = np.zeros(size, dtype=np.int64)
        for text, i in self.tokenizer.get_vocab().items():
            self.token_bytes[i] = len(text)  # the byte alphabet has one character a byte
        self.memo_chunks = memo_chunks
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=self.dtype)

    def _marked(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows with an added token, which the library cuts out before anything else."""
        text, rows = data.tobytes(), set()
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(token) <= offsets[row + 1]:
                    rows.add(row)
                at = text.find(token, at + 1)
        return np.array(sorted(rows), dtype=np.int64)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Chunk limits: 0, every sure cut outside of the rows that stay whole, every row offset, the end."""
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        if n > 1:
            prev, cur = data[:-1], data[1:]
            visible, letter = _VISIBLE[prev], _ALPHA[prev]
            if n > 2:
                two = _LEAD2[data[:-2]]
                visible[1:] |= two
                letter[1:] |= (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
            edge[1:n] = (tk.IS_SPACE[cur] & visible) | (_PUNCT[cur] & letter)
        for row in whole.tolist():
            edge[offsets[row] : offsets[row + 1]] = False
        edge[offsets] = True
        edge[0] = edge[n] = True
        return np.flatnonzero(edge)

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and for each row the number of ids before it."""
        rows = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, dtype=self.dtype), np.zeros(rows + 1, dtype=np.int64)
        marked = self._marked(data, offsets)
        cuts = self._cuts(data, offsets, marked)
        starts, ends = cuts[:-1], cuts[1:]
        whole = np.isin(starts, offsets[marked])
        long_ = np.flatnonzero((ends - starts >= LONG_CHUNK) | whole)
        keys = tk.Prefix.of_bytes(data).hash(starts, ends)
        # a long chunk gets a key of its own below, from its place
        short = np.ones(len(starts), dtype=bool)
        short[long_] = False
        unique, first, inverse = np.unique(keys[short], return_index=True, return_inverse=True)
        where = np.flatnonzero(short)[first]
        self._learn(unique, data, starts[where], ends[where])
        slot = np.searchsorted(self.keys, unique)
        at = np.zeros(len(starts), dtype=np.int64)
        size = np.zeros(len(starts), dtype=np.int64)
        at[short], size[short] = self.at[slot][inverse], self.size[slot][inverse]
        source = self.ids
        if len(long_):
            own = [np.array((self.plain if w else self.tokenizer).encode(data[s:e].tobytes().decode("utf-8"), add_special_tokens=False).ids, dtype=self.dtype) for s, e, w in zip(starts[long_], ends[long_], whole[long_], strict=True)]
            size[long_] = [len(x) for x in own]
            at[long_] = len(source) + np.cumsum(size[long_]) - size[long_]
            source = np.concatenate([source, *own])
        ids = source[tk.spread(at, size)]
        before = np.concatenate([[0], np.cumsum(size)])
        return ids, before[np.searchsorted(starts, offsets)]

    def _encode(self, chunk: bytes) -> list[int]:
        return self.tokenizer.encode(chunk.decode("utf-8"), add_special_tokens=False).ids

    def _learn(self, unique: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Adds the chunks (by ascending key) that the memo doesn't hold yet."""
        if len(self.keys) + len(unique) > max(self.memo_chunks, len(unique)):
            self._empty()
        slot = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = slot < len(self.keys)
        known[inside] = self.keys[slot[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if not len(new):
            return
        keys, s, e = unique[new], starts[new], ends[new]
        # chunks that begin with white space and end visibly can follow each other in one text
        chain = tk.IS_SPACE[data[s]] & _VISIBLE[data[e - 1]]
        parts, sizes = [], np.zeros(len(new), dtype=np.int64)
        order = np.concatenate([np.flatnonzero(chain), np.flatnonzero(~chain)])
        if (n := int(chain.sum())) > 0:
            cs, ce = s[order[:n]], e[order[:n]]
            text = data[tk.spread(cs, ce - cs)]
            ends_at = np.cumsum(ce - cs)
            done = 0
            for lo in range(0, n, 4096):  # many short texts cost less than a long one
                hi = min(n, lo + 4096)
                stop = int(ends_at[hi - 1])
                got = np.array(self._encode(text[done:stop].tobytes()), dtype=np.int64)
                token_ends = done + np.cumsum(self.token_bytes[got])
                upto = np.searchsorted(token_ends, ends_at[lo:hi], side="right")
                if int(token_ends[-1]) != stop or not np.array_equal(token_ends[upto - 1], ends_at[lo:hi]):
                    raise ValueError("the tokenizer merged across a sure cut: it isn't the byte-level BPE that this encoder expects")
                sizes[order[lo:hi]] = np.diff(upto, prepend=0)
                parts.append(got.astype(self.dtype))
                done = stop
        if n < len(new):
            alone = order[n:]
            got = self.tokenizer.encode_batch([data[a:b].tobytes().decode("utf-8") for a, b in zip(s[alone], e[alone], strict=True)], add_special_tokens=False)
            sizes[alone] = [len(x.ids) for x in got]
            parts += [np.array(x.ids, dtype=self.dtype) for x in got]
        at = np.empty(len(new), dtype=np.int64)
        at[order] = len(self.ids) + np.cumsum(sizes[order]) - sizes[order]
        self.ids = np.concatenate([self.ids, *parts])
        put = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, put, keys)
        self.at = np.insert(self.at, put, at)
        self.size = np.insert(self.size, put, sizes)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; made once, then kept."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    """The installed public byte-level vocabulary; only its place is used, it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
