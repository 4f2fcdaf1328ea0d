"""Token ids of whole texts with a public byte-level BPE vocabulary, of which each distinct word is encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
WORDS_KEPT, SEEN_BITS, WORDS_TOGETHER = 600_000, 23, 200
SLICE_BYTES = 8 << 20
CUT = re.compile(r"(?<=\S)(?= \S)")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
        yield at, end
        at = end


def _odd(word: str) -> bool:
    return not word or word[0].isspace() or word[-1].isspace()


def _cut_at_spaces(made: dict) -> bool:
    """Whether a tokenizer (its JSON) gives a text the ids of its words, each behind its space."""
    model, before = made["model"], made["pre_tokenizer"] or {}
    bytewise = made["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    whole = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    alone = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or any(c.isspace() for c in x["content"]) for x in made["added_tokens"])
    return bool(bytewise and whole and alone and made["truncation"] is None and made["padding"] is None)


class Encoder:
    """Ids as little-endian unsigned 16-bit integers (the vocabulary must be smaller than 65,536).

    A space between two other non-space characters always begins a new piece, so a text's ids are those of its words,
    each behind its space. Arrow splits texts and numbers their distinct words; these are encoded by the tokenizers
    library, many in one string, which is cut again where the bytes of its ids add up to a word. Words that come again
    in a later call are kept, up to a bound, so that the many words that occur once don't crowd them out. Where white
    space meets a space, the text is encoded by pieces. The vocabulary's added tokens (``<|endoftext|>``) are found in
    texts as the library finds them by default.

    All this holds for a byte-level vocabulary alone: with any other, texts are handed to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        if max(vocab.values()) > 65535:
            raise ValueError("the vocabulary has ids beyond 16 bits")
        self.size = max(vocab.values()) + 1
        self.bytes_of = np.zeros(self.size, np.int64)
        for piece, i in vocab.items():
            self.bytes_of[i] = len(piece)  # the alphabet has one character for each byte
        made = json.loads(self.tok.to_str())
        for x in made["added_tokens"]:
            self.bytes_of[x["id"]] = len(x["content"].encode())
        self.by_words = _cut_at_spaces(made)
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {"": b""}
        self.seen = bytearray(1 << SEEN_BITS)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def _first(self, word: str) -> bytes:
        """Ids of a text's first part, which no space precedes."""
        found = self.firsts.get(word)
        if found is None:
            found = self._ids(word)
            if len(word) < 32 and len(self.firsts) < WORDS_KEPT // 10:
                self.firsts[word] = found
        return found

    def _pieces(self, text: str) -> bytes:
        out, held, size = [], [], 0
        for piece in CUT.split(text):
            held.append(piece)
            size += len(piece)
            if size > 65536:
                out.append(self._ids("".join(held)))
                held, size = [], 0
        return b"".join([*out, self._ids("".join(held))])

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of words, each behind a space, that neither are empty nor begin or end with white space."""
        if not new:
            return []
        strings = [" " + " ".join(new[at : at + WORDS_TOGETHER]) for at in range(0, len(new), WORDS_TOGETHER)]
        flat: list[int] = []
        for e in self.tok.encode_batch_fast(strings, add_special_tokens=False):
            flat += e.ids
        ids = np.array(flat, np.uint16)
        sizes = np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in new), np.int64, len(new)) + 1
        cuts = (2 * (np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)) + 1)).tolist()
        raw = ids.tobytes()
        return [raw[a:z] for a, z in zip([0, *cuts], cuts)]

    def encode(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text (UTF-8, as binary; null: empty), with ``end`` behind them."""
        texts = pc.fill_null(texts, b"")
        try:
            texts = texts.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([x.as_py().decode("utf-8", "replace") for x in texts], pa.string())
        some = self._some if self.by_words else self._whole
        parts = [some(texts[a:z], end) for a, z in slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def _whole(self, texts: pa.Array, end: bytes) -> pa.Array:
        return pa.array([self._ids(t) + end for t in texts.to_pylist()], pa.binary())

    def _some(self, texts: pa.Array, end: bytes) -> pa.Array:
        if len(self.words) > WORDS_KEPT:
            self._forget()
        split = pc.split_pattern(texts, " ")
        ends = split.offsets.to_numpy()
        ends = ends - ends[0]
        starts = ends[:-1]
        numbered = split.flatten().dictionary_encode()
        index = numbered.indices.to_numpy().astype(np.int64)
        names = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts = [names[i] for i in index[starts].tolist()]
        pool = list(map(self.words.get, names))
        missing = [i for i, x in enumerate(pool) if x is None]
        odd = [i for i in missing if _odd(names[i])]
        slow: set[int] = {j for j, w in enumerate(firsts) if w[-1:].isspace() and ends[j + 1] - ends[j] > 1}
        if odd:
            at = np.zeros(len(names), bool)
            at[odd] = True
            hit = at[index]
            hit[starts] = False
            slow |= set((np.searchsorted(ends, np.flatnonzero(hit), "right") - 1).tolist())
            for i in odd:
                pool[i] = b""
            missing = [i for i in missing if pool[i] is None]
        new = [names[i] for i in missing]
        seen, mask = self.seen, (1 << SEEN_BITS) - 1
        for i, w, ids in zip(missing, new, self._learn(new)):
            pool[i] = ids
            h = hash(w) & mask
            if seen[h]:
                self.words[w] = ids
            else:
                seen[h] = 1
        # the first parts' own ids, and the end, behind the words'
        index[starts] = len(pool) + np.arange(len(starts))
        pool += map(self._first, firsts)
        index = np.insert(index, ends[1:], len(pool))
        pool.append(end)
        ids = pa.array(pool, pa.binary()).take(pa.array(index))
        bounds = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)[ends + np.arange(len(ends))]
        out = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(bounds)), ids.buffers()[2]])
        if slow:
            rows = out.to_pylist()
            for j in slow:
                rows[j] = self._pieces(texts[j].as_py()) + end
            out = pa.array(rows, pa.binary())
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self.encode(pa.array([t.encode() for t in texts], pa.binary())).to_pylist()


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path and Python worker."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
