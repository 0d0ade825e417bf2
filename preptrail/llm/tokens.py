"""Encoders over public vocabulary files; the files' paths are parameters."""

import base64
import re
from collections.abc import Callable

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Below this code point both libraries split texts alike (tested for each one); a text with any
#: other character goes to the library that defines the ids.
OTHER = re.compile("[^\\u0000-\\u2fff]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes from a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_encoder(rank_path: str, json_path: str, pattern: str) -> Callable[[], tuple[Callable[[str], list[int]], np.ndarray]]:
    """Encoder factory for ``packing.pack``: ids of ``json_path``, as its library gives them by default.

    ``rank_path`` holds the same vocabulary as ranks; its library gives the same ids several times
    faster on texts without characters of ``OTHER`` and without the strings of added tokens, which the
    library of ``json_path`` reads as these tokens.
    """
    more = Tokenizer.from_file(json_path).get_added_tokens_decoder()
    added = [token.content for token in more.values()]

    def make() -> tuple[Callable[[str], list[int]], np.ndarray]:
        ranks = read_ranks(rank_path)
        quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        exact: list[Tokenizer] = []

        def encode(text: str) -> list[int]:
            if OTHER.search(text) is None and not any(token in text for token in added):
                return quick.encode_ordinary(text)
            if not exact:
                exact.append(Tokenizer.from_file(json_path))
            return exact[0].encode(text, add_special_tokens=False).ids

        sentence_end = np.zeros(max(*ranks.values(), *more) + 1, dtype=bool)
        for token, rank in ranks.items():
            sentence_end[rank] = token[-1:] in b".!?\n"
        return encode, sentence_end

    return make
