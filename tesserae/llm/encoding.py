"""Whole texts to token ids, with every distinct word of a batch encoded once.

word_bpe_49k.json normalises (NFC, white space, lower case), splits at white space and encodes each piece alone, and its
special strings hold no white space; so the ids of a text are those of its space-separated chunks in order. A batch is cut
at ASCII spaces and line feeds by Arrow, its distinct chunks are encoded, and the ids are gathered by numpy. test_encoding
holds this against the library's own encoding of whole texts.
"""

from __future__ import annotations

import gc
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .idle import busy, idle

WORD_BPE = "word_bpe_49k.json"
#: Pieces that a worker keeps between batches and tasks; beyond it the store starts anew, which bounds its memory.
KEPT_UNITS = 1_000_000
#: Documents encoded together: the more there are, the fewer words of a batch are new to it.
ENCODED_ROWS = 1500


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters whose lower case and normal form are themselves or one letter each, and marks that end a word.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: Marks that begin a new piece behind letters, all but those of contractions and special strings.
MARKS = r"""!"#$%&()*+,-./:;=?@[\]^_`{}~"""
PLAIN_WORD = LETTERS + r"[!-&(-/:;=?@\[-`{}~]*$"


class WordEncoder:
    """Encodes batches of texts; `path` names a tokenizer whose pieces never cross an ASCII space or line feed.

    A word of plain letters with marks behind it is two pieces, which are kept apart, since far fewer letter runs than
    words are distinct. Lower-cased letter runs go to the tokenizer's model without its normaliser, which wouldn't change
    them, many at once: each ends with the only id whose token carries the end-of-word mark.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.kept = KEPT_UNITS
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, int] = {"": 0}
        self.starts, self.lengths, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _add_units(self, units: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        starts = self.ids.size + np.cumsum(lengths) - lengths
        self.units.update(zip(units, range(len(self.units), len(self.units) + len(units)), strict=True))
        self.starts, self.lengths, self.ids = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, flat])

    def _places(self, units: pa.Array, plain: np.ndarray) -> np.ndarray:
        """The places in the store of distinct units, of which some are plain letter runs; new ones are encoded."""
        names = units.to_pylist()
        found = list(map(self.units.get, names))
        new = [k for k, place in enumerate(found) if place is None]
        letters, others = [names[k] for k in new if plain[k]], [names[k] for k in new if not plain[k]]
        if letters:
            flat = np.array(self.plain.encode(" ".join(letters), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[flat]) + 1
            if len(ends) != len(letters):
                raise ValueError("the tokenizer's words don't end with its end-of-word mark")
            self._add_units(letters, np.diff(ends, prepend=0), flat)
        if others:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._add_units(others, lengths, np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())))
        for k in new:
            found[k] = self.units[names[k]]
        return np.array(found, np.int64)

    def _pairs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The two units of each distinct word, by their places in the store. Words are cut and lower-cased by Arrow."""
        if not self.ends.any():
            return self._places(words, np.zeros(len(words), bool)), np.zeros(len(words), np.int64)
        plain = pc.match_substring_regex(words, PLAIN_WORD)
        heads = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, MARKS)), words).dictionary_encode()
        marks = pc.if_else(plain, pc.replace_substring_regex(words, LETTERS, ""), "").dictionary_encode()
        kind, of = np.zeros(len(heads.dictionary), bool), heads.indices.to_numpy()
        kind[of] = plain.to_numpy(zero_copy_only=False)
        first = self._places(heads.dictionary, kind)[of]
        return first, self._places(marks.dictionary, np.zeros(len(marks.dictionary), bool))[marks.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as uint32, ids per text); a null text has none.

        The collector rests meanwhile: what is made here has no cycles, and it would walk the store again and again.
        """
        resting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if resting:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")  # an empty chunk has no ids
        per_text = np.diff(chunks.offsets.to_numpy())
        coded = chunks.flatten().dictionary_encode()
        words = coded.dictionary
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(self.units) > self.kept:
            self.clear()
        heads, marks = self._pairs(words)
        own = self.lengths[heads] + self.lengths[marks]  # ids of each distinct word
        index = coded.indices.to_numpy()
        # lay out the distinct words' ids once, then gather them for all words
        units = np.stack([heads, marks], 1).ravel()
        lengths = self.lengths[units]
        ends = np.cumsum(lengths)
        laid = self.ids[np.repeat(self.starts[units] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]
        first = np.cumsum(own) - own
        lengths = own[index]
        ends = np.cumsum(lengths)
        flat = laid[np.repeat(first[index] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]
        upto = np.concatenate([[0], ends])
        return flat, np.diff(upto[np.concatenate([[0], np.cumsum(per_text)])])


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str, kept: int = KEPT_UNITS) -> WordEncoder:
    """The worker's encoder for a tokenizer file; it outlives a task, as Spark's Python workers do, until let_go."""
    busy()
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    _encoders[path].kept = kept
    return _encoders[path]


def let_go() -> None:
    """A task has ended: its encoder goes once the worker has been idle for some seconds."""
    idle(_encoders.clear)
