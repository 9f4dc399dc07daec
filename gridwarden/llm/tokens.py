"""Token ids of whole texts with a public byte-level vocabulary."""

import base64
import struct

#: Fixed value: the token beside the ranks; its id follows theirs.
ADDED = "<|endoftext|>"


def token_encoder(ranks=None):
    """A function from a text to its ids, packed as little-endian unsigned 32-bit numbers.

    ``ranks``: path of a rank file; the installed 50k byte vocabulary if not given, whose ids
    are those of ``byte_bpe_50k.json``. As there, its one added token is a token in any text.
    """
    import public_tokenizers
    import tiktoken
    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("text", pat_str=public_tokenizers.PATTERN,
                                 mergeable_ranks=table, special_tokens={ADDED: len(table)})

    def encode(text):
        ids = (encoding.encode(text, allowed_special={ADDED}) if ADDED in text
               else encoding.encode_ordinary(text))
        return struct.pack(f"<{len(ids)}I", *ids)

    return encode
