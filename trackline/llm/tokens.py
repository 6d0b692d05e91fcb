"""Token ids of whole texts by a public BPE vocabulary, remembered per word."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

# Pieces whose ids a Python worker remembers; what comes beyond is encoded anew each time.
REMEMBERED = 500_000
# How the lower-case vocabulary parts a text, and the end mark of a word's last token.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
# Characters that every Unicode library lowers and parts alike; words with others go to the tokenizer whole.
PLAIN = r"!-~¡-¬®-įı-ňŊ-žƀ-ɏ"
BLANK = r"\x20\x09-\x0D"
WHOLE = "\0"  # in front of a word that goes whole; no piece has it


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def plain_pieces():
    """``PIECES`` for lowered text of plain characters, with its letters and numbers spelt out: all that ``re`` needs."""
    import re

    low = {c for i in range(0x250) if re.fullmatch(f"[{PLAIN}]", chr(i)) for c in chr(i).lower()}
    kind = lambda first: "".join(re.escape(c) for c in sorted(low) if unicodedata.category(c)[0] == first)
    return re.compile(PIECES.replace(r"\p{L}", f"[{kind('L')}]").replace(r"\p{N}", f"[{kind('N')}]").replace(
        rf"[^\s[{kind('L')}][{kind('N')}]]", f"[^{BLANK}{kind('L')}{kind('N')}]"
    )).findall


class WordTokenizer:
    """Little-endian 32-bit ids of a text, the same as the tokenizer gives without special tokens.

    The vocabulary drops white space and ends a token at each piece's end, so a text's ids are those of its pieces in
    a row. A text is parted in one go, pieces are looked up, and only unseen ones are encoded, many in one call.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab(True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.parts = plain_pieces()
        self.plain = re.compile(f"[{PLAIN}{BLANK}]*").fullmatch
        # A word with another character, or with what may begin a special token; looked for at the start of words only.
        self.odd = re.compile(rf"(?<![^{BLANK}])([^{BLANK}]*(?:[^{PLAIN}{BLANK}]|<\|)[^{BLANK}]*)").split
        self.pieces: dict[str, bytes] = {}

    def parted(self, text: str | None) -> list[str]:
        """The pieces of a text, and with ``WHOLE`` in front the words that are not parted here."""
        if not text:
            return []
        if self.plain(text) and "<|" not in text:
            return self.parts(text.lower())
        out: list[str] = []
        for i, part in enumerate(self.odd(text)):
            if i % 2:
                out.append(WHOLE + part.encode("utf-8", "surrogatepass").decode("utf-8", "replace"))
            else:
                out += self.parts(part.lower())
        return out

    def encode_pieces(self, pieces: list[str], size: int = 200) -> dict[str, bytes]:
        groups = [pieces[i : i + size] for i in range(0, len(pieces), size)]
        found: dict[str, bytes] = {}
        encoded = self.model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, one in zip(groups, encoded):
            ids = np.asarray(one.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group) and stops[-1] == len(ids):
                data, at = ids.tobytes(), 0
                for piece, stop in zip(group, (4 * stops).tolist()):
                    found[piece] = data[at:stop]
                    at = stop
            else:
                for piece in group:
                    found[piece] = self.encode_whole(piece)
        return found

    def encode_whole(self, word: str) -> bytes:
        return np.asarray(self.model.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; empty for null."""
        known, looked = self.pieces, []
        unseen: set[str] = set()
        for text in texts:
            pieces = self.parted(text)
            data = list(map(known.get, pieces))
            if None in data:
                unseen.update([p for p, d in zip(pieces, data) if d is None])
                looked.append((pieces, data))
            else:
                looked.append((None, data))
        fresh = self.encode_pieces([p for p in unseen if p[0] != WHOLE]) if unseen else {}
        fresh |= {p: self.encode_whole(p[1:]) for p in unseen if p[0] == WHOLE}
        known.update(list(fresh.items())[: max(0, REMEMBERED - len(known))])
        return [
            b"".join(data if pieces is None else [fresh[p] if d is None else d for p, d in zip(pieces, data)])
            for pieces, data in looked
        ]


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker, so that what a task has learned serves the next one."""
    return WordTokenizer(path)
