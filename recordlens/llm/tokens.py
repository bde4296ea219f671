"""Token ids of whole columns of text by a public tokenizer; words met before are not encoded again."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from recordlens.llm.common import block_of, release_memory, within

# Words a worker remembers before it starts anew.
REMEMBERED = 700_000
# Bytes of text whose words are looked up together.
BATCH_BYTES = 4 << 20

# A text of visible ASCII and Latin-1 characters with single spaces or line feeds between words. Only
# white space ends a word for both kinds of tokenizers here, so such words can be encoded one by one.
SIMPLE = "^[\\x21-\\x7e¡-ÿ]+([ \\n][\\x21-\\x7e¡-ÿ]+)*$"
# Marks of a word, or a rest of one, with nothing before it, and of a word after a line feed; no such text holds these characters.
FIRST, AFTER_FEED = "\x01", "\x02"
# Bytes that letters of such texts consist of. Words with other characters beyond ASCII (a byte 0xC2, or the signs of
# multiplication and division) are not cut.
LETTER_BYTE = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes like ``Tokenizer.encode(text, add_special_tokens=False)``.

    ``spaces`` says that the white space before a word belongs to its ids (byte-level vocabularies).
    """

    def __init__(self, path: str, spaces: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaces = spaces
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.uint32 if self.wide else np.uint16
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids = np.zeros(1 << 16, self.dtype)
        self.used = 0
        self.at = np.zeros(1 << 12, np.int64)
        self.len = np.zeros(1 << 12, np.int32)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words of letters only: many at a time, as each is one word to the tokenizer."""
        ids, counts = [], []
        lead = "" if self.spaces else " "
        for lo in range(0, len(words), 512):
            some = words[lo : lo + 512]
            e = self.tokenizer.encode(lead.join(some), add_special_tokens=False)
            ids.append(np.array(e.ids, self.dtype))
            counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(ids), np.concatenate(counts)

    def _text(self, unit: str) -> str:
        """What a unit stands for in its text: a word has a space before it unless a mark says otherwise."""
        if unit[:1] == FIRST:
            return unit[1:]
        if unit[:1] == AFTER_FEED:
            return "\n" + unit[1:]
        return " " + unit

    def _learn(self, units: list[str]) -> None:
        words = [u for u in units if u.isalpha()]
        others = [u for u in units if not u.isalpha()]
        for kind, new in ((True, words), (False, others)):
            if not new:
                continue
            if kind:
                ids, counts = self._letters([" " + u for u in new] if self.spaces else new)
            else:
                lists = self._plain([self._text(u) for u in new] if self.spaces else new)
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                ids = np.fromiter((i for x in lists for i in x), self.dtype, int(counts.sum()))
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            first = len(self.known)
            while first + len(new) > len(self.at):
                self.at = np.concatenate([self.at, np.zeros_like(self.at)])
                self.len = np.concatenate([self.len, np.zeros_like(self.len)])
            self.at[first : first + len(new)] = self.used + np.cumsum(counts) - counts
            self.len[first : first + len(new)] = counts
            self.used += len(ids)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))

    def _units(self, words: pa.Array) -> pa.Array:
        """Two units of every word: its leading letters and the rest; without letters all of it and nothing."""
        block = block_of(words)
        n = len(words)
        stop = ~LETTER_BYTE[block.data]
        begin, end = block.starts[:-1], block.starts[1:]
        marked = np.zeros(n, np.int64)
        if self.spaces:
            marked = (block.data[begin] < 3).astype(np.int64)
            stop[begin[marked > 0]] = False
        # The first byte of each word that is no letter, or its end.
        at = np.flatnonzero(stop)
        k = np.searchsorted(at, begin)
        cut = np.minimum(np.concatenate([at, [len(stop)]])[k], end)
        odd = (block.data == 0xC2) | (block.data == 0x97) | (block.data == 0xB7)
        odd = np.concatenate([[0], np.cumsum(odd)])
        cut = np.where((cut - begin - marked > 0) & (odd[end] == odd[begin]), cut, end)
        if self.spaces:
            # A rest is never a word after a space: it is told from one by a mark.
            tail = np.where((cut < end)[:, None], np.array([[1]], np.uint8), 0)
            size = np.column_stack([cut - begin, end - cut + (cut < end)]).ravel()
            out = np.empty(int(size.sum()), np.uint8)
            offsets = np.concatenate([[0], np.cumsum(size)])
            body = np.ones(len(out), bool)
            body[offsets[1:-1:2][cut < end]] = False
            out[body] = block.data
            out[~body] = tail[cut < end].ravel()
        else:
            out = block.data
            offsets = np.concatenate([[0], np.column_stack([cut, end]).ravel()])
        return pa.Array.from_buffers(
            pa.large_string(), 2 * n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))]
        )

    def _simple(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        if self.spaces:
            marked = pc.binary_join_element_wise(FIRST, pc.replace_substring(texts, "\n", " " + AFTER_FEED), "")
        else:
            marked = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(marked, " ")
        per_text = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        words = pc.list_flatten(lists).dictionary_encode()
        coded = self._units(words.dictionary).dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = self.known
        missing = [u for u in names if u not in known]
        if missing:
            self._learn(missing)
        place = np.array([known[u] for u in names], np.int64)[np.asarray(coded.indices)].reshape(-1, 2)
        word = place[np.asarray(words.indices)].ravel()
        n = self.len[word]
        ends = np.cumsum(n, dtype=np.int64)
        ids = self.ids[np.repeat(self.at[word] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        last = 2 * np.cumsum(per_text) - 1
        return ids, np.diff(ends[last], prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has. A null text has none."""
        texts = pc.fill_null(texts, "")
        simple = np.asarray(pc.match_substring_regex(texts, SIMPLE))
        if len(texts) and simple.all():
            return self._simple(texts)
        other = self._plain(texts.filter(pa.array(~simple)).to_pylist())
        counts = np.zeros(len(texts), np.int64)
        counts[~simple] = np.fromiter(map(len, other), np.int64, len(other))
        ids = np.zeros(0, self.dtype)
        if simple.any():
            ids, counts[simple] = self._simple(texts.filter(pa.array(simple)))
        out = np.empty(int(counts.sum()), self.dtype)
        begin = np.cumsum(counts) - counts
        n = counts[simple]
        out[np.repeat(begin[simple], n) + within(n)] = ids
        n = counts[~simple]
        out[np.repeat(begin[~simple], n) + within(n)] = np.fromiter((i for x in other for i in x), self.dtype, int(n.sum()))
        return out, counts

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, with ``end_id`` after every text."""
        ids, counts = self.encode(texts)
        ends = np.cumsum(counts)
        return np.insert(ids, ends, end_id), counts + 1


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """The worker's encoder for a vocabulary, kept for its next tasks."""
    key = (path, spaces)
    if key not in _encoders:
        _encoders[key] = Encoder(path, spaces)
    return _encoders[key]


def forget_encoders() -> None:
    """Drop the worker's encoders and what they remember; a later stage that encodes nothing needs the memory."""
    _encoders.clear()
    release_memory()
