"""Byte-level BPE of the tokenizers library, one pre-token at a time.

The tokenizer cuts a text into pre-tokens before it merges bytes, and no merge reaches over a cut.
The same cuts are made here, so each distinct pre-token goes through the library's model only once
for as long as a worker remembers it. Texts are cut in two steps: Arrow parts a whole batch into
words, each with the space before it (there is always a cut before a space that something other
than white space follows), and only a batch's distinct words are cut on by the pattern.
"""

from __future__ import annotations

import re
from array import array
from codecs import charmap_decode
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from factgraph.llm.common import Memo

# The published pre-token pattern of byte-level BPE. L, N and S stand for letters,
# numbers and white space of Unicode.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Characters up to U+024F and marks of U+2010 to U+2027, whose kinds are listed here; such texts are
#: cut by the faster expression.
_LATIN = re.compile("[\0-\u024f\u2010-\u2027]*")
_LATIN_CUT = re.compile(_PATTERN.format(L="A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", N="0-9\u00b2\u00b3\u00b9\u00bc-\u00be", S="\\t-\\r \x85\xa0"))
#: Characters whose kinds no version of Unicode in use disagrees on; texts with any other are cut by
#: the library itself.
_SETTLED = re.compile("[\0-\u036f\u0400-\u04ff\u2010-\u205e\u20a0-\u20b5\u3001-\u3096\u309b-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]*")
# White space of Unicode, as members of a class.
_SPACES = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A space before white space or the end, which leads no word, and one before a word.
_LONE_SPACE = f" (?:[{_SPACES}]|$)"
_LED = re.compile(" (?=[^" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), _SPACES) + "])")
#: Byte-level BPE writes printable Latin-1 bytes as themselves and the others as U+0100 and up.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_CHARS = "".join(chr(b if b in _PRINTABLE else 0x100 + _HIDDEN.index(b)) for b in range(256))


def _strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()


class ByteBpe:
    """Ids of whole texts, without added special tokens; special strings inside texts are read as
    the library does by default."""

    def __init__(self, path: str, limit: int = 100 << 20):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        pre = self.tokenizer.pre_tokenizer
        added = self.tokenizer.get_added_tokens_decoder().values()
        plain = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and self.tokenizer.normalizer is None
        #: Whether texts are cut here; else each whole text goes through the library.
        self.cuts = plain and not any(x.lstrip or x.rstrip or x.single_word for x in added)
        self.special = {x.content for x in added}
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._unicode_cut = regex.compile(_PATTERN.format(L=r"\p{L}", N=r"\p{N}", S=r"\p{White_Space}")).findall
        self.ids = Memo(self._encode_words, limit, 140)

    def _tokenized(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token, by the library's model."""
        flat, ends, tokenize, special = array(self.dtype.char), [], self.tokenizer.model.tokenize, self.special
        for piece in pieces:
            if not self.cuts or piece in special:
                flat.extend(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            else:
                flat.extend([t.id for t in tokenize(charmap_decode(piece.encode(), "strict", _BYTE_CHARS)[0])])
            ends.append(len(flat) * self.dtype.itemsize)
        data = flat.tobytes()
        return [data[x:y] for x, y in zip([0, *ends], ends, strict=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        cut = self.cut(words)
        pieces = list(dict.fromkeys(chain.from_iterable(cut)))
        known = dict(zip(pieces, self._tokenized(pieces), strict=True))
        return [known[x[0]] if len(x) == 1 else b"".join([known[y] for y in x]) for x in cut]

    def cut(self, words: list[str]) -> list[tuple[str, ...] | list[str]]:
        """The pre-tokens of texts without special strings, or of such strings."""
        settled, pieces = _SETTLED.fullmatch, self.pieces
        # Letters, with a space before them or not, are one pre-token.
        return [(x,) if (x[1:] if x[:1] == " " else x).isalpha() and (x.isascii() or settled(x)) and self.cuts else pieces(x) for x in words]

    def pieces(self, word: str) -> list[str]:
        if not self.cuts or word in self.special:
            return [word] if word else []
        if word.isascii() or _LATIN.fullmatch(word):
            return _LATIN_CUT.findall(word)
        if _SETTLED.fullmatch(word):
            return self._unicode_cut(word)
        return [word[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(word)]

    def words(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Parts of the texts that the tokenizer treats alone, in order, and how many each text has."""
        if not self.cuts:
            return texts.dictionary_encode(), np.ones(len(texts), np.int64)
        mark = next(c for c in map(chr, range(0xD800)) if not pc.any(pc.match_substring(texts, c)).as_py())
        odd = pc.match_substring_regex(texts, _LONE_SPACE)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        marked = pc.replace_substring(texts, " ", f"{mark} ")
        if pc.any(odd).as_py():
            marked = pc.replace_with_mask(marked, odd, pa.array([self._marked(x, mark) for x in _strings(texts.filter(odd))], pa.string()))
        parts = pc.split_pattern(marked, mark)
        return parts.flatten().dictionary_encode(), parts.value_lengths().to_numpy()

    def _marked(self, text: str, mark: str) -> str:
        parts = self._specials.split(text) if self._specials else [text]
        return mark.join(x if x in self.special else _LED.sub(f"{mark} ", x) for x in parts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts (a StringArray without nulls), one after the other, and how many
        each text has."""
        words, many = self.words(texts)
        distinct = pa.array(self.ids.values(_strings(words.dictionary)), pa.binary())
        ids = distinct.take(words.indices)
        at = np.concatenate(([0], np.cumsum(many)))
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(ids).to_numpy(zero_copy_only=False), dtype=np.int64))) // self.dtype.itemsize
        data = np.frombuffer(ids.buffers()[2] or b"", self.dtype)[: ends[-1]]
        return data, np.diff(ends[at])

    def frequencies(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens of the texts; and, for each text's distinct ones: place of the text,
        place of the pre-token, and how often the text has it."""
        words, many = self.words(texts)
        cut = self.cut(_strings(words.dictionary))
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        code, starts = flat.indices.to_numpy(), np.cumsum(sizes) - sizes
        word, text = words.indices.to_numpy(), np.repeat(np.arange(len(texts)), many)
        each = sizes[word]
        within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        kinds = max(len(flat.dictionary), 1)
        pairs = np.sort(np.repeat(text, each) * kinds + code[np.repeat(starts[word], each) + within])
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])) if len(pairs) else [])
        text, piece = np.divmod(pairs[first], kinds)
        return flat.dictionary, text, piece, np.diff(first, append=len(pairs))

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        size = self.dtype.itemsize
        return [len(x) // size for x in self._tokenized(pieces)]


_loaded: dict[tuple[str, int], ByteBpe] = {}


def byte_bpe(path: str, limit: int = 100 << 20) -> ByteBpe:
    """One encoder for each worker process, kept between tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, limit) not in _loaded:
        _loaded[path, limit] = ByteBpe(path, limit)
    return _loaded[path, limit]
