"""A public piece vocabulary, read through the sentencepiece library, and what both tokenizer operators share.

The model's file is a path parameter. Its bytes (half a MB, fixed) are read on the driver and go to the tasks with the
function, so executors need no shared folder. Texts are cut where no piece can cross: before a run of spaces that follows
other characters, if no piece holds a space after another character, and around characters that are in no longer piece.
What a chunk gives is kept in a bounded memo table, as the words of a corpus repeat.
"""

from __future__ import annotations

import re

#: U+2581, which stands for a space.
SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """surface: the pieces by id. kind: "normal", "byte", "control" or "unknown" by id. ids: normal pieces' ids."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        probe = " a  Ａ\n "
        if sp.normalize(probe) != (SPACE + probe).replace(" ", SPACE):
            raise ValueError("only models with identity normalisation, escaped spaces and a dummy prefix are supported")
        n = sp.get_piece_size()
        self.surface = [sp.id_to_piece(i) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.kind = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "normal" for i in range(n)]
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.surface, self.kind)) if k == "normal"}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.surface, self.kind)) if k == "byte"}
        self.unknown = self.kind.index("unknown")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            self.chunks = lambda text: [text]
        else:
            longer = {c for p in self.ids if len(p) > 1 for c in p}
            alone = "".join(c for c in "\n\t\r" if c not in longer)
            self.chunks = re.compile(f"[{alone}]| *[^ {alone}]+| +" if alone else " *[^ ]+| +").findall

    def normalised(self, text: str) -> str:
        """The text as the library sees it: a space before it, all spaces as U+2581."""
        return (SPACE + text).replace(" ", SPACE) if text else ""

    def spaced(self, text: str) -> str:
        """The same with spaces, which chunks() takes: most chunks are ASCII then, and take half the memory as keys."""
        return (" " + text).replace(SPACE, " ") if text else ""

    def fallback(self, character: str) -> list[int]:
        """The ids of a character that has no piece of its own."""
        return [self.byte_ids[b] for b in character.encode()] if len(self.byte_ids) == 256 else [self.unknown]
