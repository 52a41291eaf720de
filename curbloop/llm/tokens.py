"""Exact token ids of whole texts with a cache of word encodings.

A byte pair encoder never merges across the borders of its pre-tokens, so a text may be cut at such borders and every
piece encoded once. Texts that hold a special token are encoded whole. Cuts are made only where a border is certain: at a single space or line end between non-spaces, and
between a Latin letter and a full stop or comma that ends a word. Any other text is encoded whole, so the ids are always
those of the library.
"""
import functools
import os
import re
from array import array

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Punctuation between a letter and the end of a word; an apostrophe may start a contraction, so it does not begin a run.
STOP = re.compile(rf"[!-&(-/:-@\[-`{{-~](?<=[{LETTERS}].)[!-/:-@\[-`{{-~]*(?=[ \n]|\Z)")
#: White space other than single spaces and line ends, and the mark used below.
WORD = re.compile(rf" ?[{LETTERS}]+").fullmatch
UNEVEN = ["  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000",
          *map(chr, range(0x2000, 0x200b)), "\x02"]
MARK = "\x02"


def _byte_alphabet() -> dict[int, str]:
    """The letters by which byte-level encoders write bytes: printable ones stand for themselves, the others follow 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


BYTE_ALPHABET = _byte_alphabet()


def byte_pieces(text: str) -> list[str] | None:
    """Pieces of a byte-level encoder; those marked have no space before them. None: the text cannot be cut."""
    if not text or text[0] in " \n" or text[-1] in " \n" or any(c in text for c in UNEVEN):
        return None
    text = STOP.sub(" \x02\\g<0>", text).replace("\n", " \x02\n \x02")
    return (MARK + text).split(" ")


def byte_piece_text(piece: str) -> str:
    return piece[1:] if piece[0] == MARK else " " + piece


def word_pieces(text: str) -> list[str]:
    """Pieces of an encoder that drops white space."""
    return [p for p in STOP.sub(" \\g<0>", text).replace("\n", " ").split(" ") if p]


class Learned(dict):
    """Ids of pieces. A piece that is not there is encoded when it is asked for. When half of ``max_kept`` pieces are held, they
    become the older half, from which those that are asked for again come back; the older half before it goes. Long pieces are not
    kept, so the memory is bounded by the number of pieces."""

    LONGEST = 48  # characters of a kept piece

    def __init__(self, tokenizer, piece_text, lower: bool, max_kept: int):
        self.tokenizer, self.tokenize, self.piece_text, self.lower = tokenizer, tokenizer.model.tokenize, piece_text, lower
        self.older, self.half = {}, max(1, max_kept // 2)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            text = self.piece_text(piece)
            if WORD(text):  # one pre-token: straight to the merges
                word = (text.lower() if self.lower else text).encode().decode("latin-1").translate(BYTE_ALPHABET)
                ids = array("I", [t.id for t in self.tokenize(word)]).tobytes()
            else:
                ids = array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        if len(piece) <= self.LONGEST:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """``encode`` gives the ids of each text as little-endian unsigned 32-bit integers, as the library's ``encode`` with
    ``add_special_tokens=False``. Up to ``max_cached`` pieces (some 250 bytes each) stay from call to call and from task to task."""

    def __init__(self, path: str, max_cached: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        kind = type(self.tokenizer.pre_tokenizer).__name__
        whole_words = self.tokenizer.model.end_of_word_suffix == "</w>"
        self.special = {t.content: i for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)}
        self.pieces = piece_text = None
        if len(self.special) == len(added) and added:
            if kind == "ByteLevel" and not self.tokenizer.pre_tokenizer.add_prefix_space:
                self.pieces, piece_text = byte_pieces, byte_piece_text
            elif kind == "Sequence" and whole_words:
                self.pieces, piece_text = word_pieces, str
        self.cache = Learned(self.tokenizer, piece_text, self.pieces is word_pieces, max_cached)

    def encode(self, texts: list[str]) -> list[bytes]:
        import gc
        collects = gc.isenabled()
        gc.disable()  # lists of many pieces live shortly and hold no cycles
        try:
            return [self._encode(text) for text in texts]
        finally:
            if collects:
                gc.enable()

    def _encode(self, text: str) -> bytes:
        pieces = self.pieces(text) if self.pieces and not any(s in text for s in self.special) else None
        if pieces is None:
            return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        return b"".join(map(self.cache.__getitem__, pieces))


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def public_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
