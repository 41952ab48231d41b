"""Token ids of texts by a public tokenizer; a worker encodes each distinct piece of text once.

Texts are cut only where the tokenizer's own pre-tokenizer always cuts, so the ids of the pieces, one after
another, are the ids of the text. Texts with characters for which that isn't plain, or with one of the tokenizer's
added tokens, are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids a worker keeps before it starts anew.
CACHE_PIECES = 200_000

WORD_FILE, BYTE_FILE = "word_bpe_49k.json", "byte_bpe_50k.json"
_LOADED: dict[str, "PieceEncoder"] = {}
_LOWER = "a-zß-öø-ɏ"
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Printable ASCII, its white space, letters of Latin-1 and Latin Extended; İ has no lower case of one letter.
_ODD = r"[^\t-\r -~À-ÖØ-öø-įı-ɏ]"
_SPACES = r"[\t-\r ][\t-\r ]"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "PieceEncoder":
    """The worker's encoder for a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets write a byte as its Latin-1 sign where that prints, else as the next sign from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.drops_space = self.tokenizer.normalizer is not None
        self.signs = _byte_letters()
        self.ids: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a run of letters, with or without a space before it; None for other pieces."""
        if not (piece[1:] if piece[:1] == " " else piece).isalpha():
            return None
        if not piece.isascii() or piece[0] == " ":
            piece = "".join([self.signs[b] for b in piece.encode()])
        return np.array([t.id for t in self.model.tokenize(piece)], dtype="<u2").tobytes()

    def _known(self, pieces: list[str]) -> list[bytes]:
        if len(self.ids) > CACHE_PIECES:
            self.ids.clear()
        others = []
        for piece in pieces:
            if piece not in self.ids:
                found = self._piece(piece)
                if found is None:
                    others.append(piece)
                else:
                    self.ids[piece] = found
        if others:
            coded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
            self.ids.update((p, np.array(e.ids, dtype="<u2").tobytes()) for p, e in zip(others, coded, strict=True))
        return [self.ids[p] for p in pieces]

    def _pieces(self, texts: pa.Array) -> pa.Array:
        if self.drops_space:
            cut = pc.replace_substring_regex(pc.utf8_lower(texts), rf"([{_LOWER}])([^{_LOWER}\s])", r"\1 \2")
            return pc.ascii_split_whitespace(cut)
        cut = pc.replace_substring(pc.replace_substring(texts, " ", "\x1e "), "\n", "\x1e\n\x1e")
        return pc.split_pattern(pc.replace_substring_regex(cut, rf"([{_LETTER}])([^{_LETTER}\s\x1e])", "\\1\x1e\\2"), "\x1e")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets per text and the ids (uint16) of all texts, one after another."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        if not self.drops_space:
            odd = pc.or_(odd, pc.match_substring_regex(texts, rf"{_SPACES}|^[\t-\r ]|[\t-\r ]$|[\t\x0b-\r]"))
        for token in self.added:  # the tokenizer looks for these in the whole text, before it cuts anything
            odd = pc.or_(odd, pc.match_substring(texts, token, ignore_case=True))
        odd = odd.to_numpy(zero_copy_only=False)
        lists = self._pieces(texts.filter(pa.array(~odd)) if odd.any() else texts)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        known = self._known(flat.dictionary.to_pylist())
        blob = np.frombuffer(b"".join(known), dtype="<u2")
        lengths = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 2
        starts = np.cumsum(lengths) - lengths
        codes = flat.indices.to_numpy(zero_copy_only=False)
        each = lengths[codes]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = blob[np.repeat(starts[codes] - (ends - each), each) + np.arange(total)]
        piece_ends = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.concatenate([[0], ends])[piece_ends]
        if not odd.any():
            return bounds, ids
        whole = self.tokenizer.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)
        whole = iter([np.array(e.ids, dtype="<u2") for e in whole])
        plain = iter([ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        each_text = [next(whole) if is_odd else next(plain) for is_odd in odd]
        return np.concatenate([[0], np.cumsum([len(x) for x in each_text])]), np.concatenate(each_text)
