"""Token counts of a byte-level BPE vocabulary with a whole-token shortcut.

Vocabulary strings that encode alone as one token are proved once, before the
job.  A pre-token among them counts as one; only the others are merged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidelog.llm.common import annotated, fields
from tidelog.llm.vocab import (
    PLAIN,
    Cache,
    byte_alphabet,
    file_bytes,
    library_tokenizer,
    merger,
)

LIMIT = 512
COUNTS = fields(n_bytes=LongType(), n_tokens=LongType())


def whole_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    alphabet = {c: b for b, c in byte_alphabet().items()}
    texts = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            texts.append(bytes(alphabet[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    single = [t for t, e in zip(texts, encoded, strict=True) if len(e.ids) == 1]
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    return frozenset(t for t in single if len(split(t)) == 1)


def counter(
    data: bytes, whole: frozenset[str], pattern: str
) -> Callable[[bytes | None], int]:
    """A function from a UTF-8 text to its number of tokens.

    A text is cut before every blank that stands between two other
    characters; no pre-token crosses such a cut, and the cuts' counts are kept
    in a bounded cache.
    """
    import regex

    tokenizer = library_tokenizer(data)
    merge = merger(tokenizer)
    pre_tokens = regex.compile(pattern).findall
    plain = regex.compile(f"[{PLAIN}]*").fullmatch
    other_space = regex.compile(r"[^\S\n ]").search
    inner_blank = regex.compile(r"(?<=\S) (?=\S)")
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def one(pre_token: str) -> int:
        return 1 if pre_token in whole else len(merge(pre_token))

    def count(part: str) -> int:
        return sum(map(one, pre_tokens(part)))

    def count_after_blank(part: str) -> int:
        return one(" " + part) if part.isalpha() else count(" " + part)

    after_blank = Cache(count_after_blank)

    def awkward(text: str) -> bool:
        """Whether a blank may stand beside white space or at an end."""
        return (
            text[:1] == " "
            or text[-1:] == " "
            or "  " in text
            or " \n" in text
            or "\n " in text
            or other_space(text) is not None
        )

    def tokens(raw: bytes | None) -> int:
        text = (raw or b"").decode()
        if any(s in text for s in special) or not plain(text):
            return len(tokenizer.encode(text, add_special_tokens=False).ids)
        parts = inner_blank.split(text) if awkward(text) else text.split(" ")
        return count(parts[0]) + sum(map(after_blank.__getitem__, parts[1:]))

    return tokens


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """Tokens of every whole text: ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``vocabulary`` is the path of a byte-level BPE file of the ``tokenizers``
    library, ``pattern`` its pre-token pattern.  Counts are those of the
    library without added special tokens; special strings inside a text count
    as it takes them.  A null text counts as empty.  One row per document,
    repeated rows too; other columns are ignored; no rows for an empty table.
    """
    data = file_bytes(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(
        (data, whole_tokens(library_tokenizer(data)), pattern)
    )

    def work():
        tokens = counter(*shared.value)
        return lambda texts: [
            [len(t or b"") for t in texts],
            [tokens(t) for t in texts],
        ]

    found = annotated(docs, text_col, [F.col(id_col).alias("id")], COUNTS, work)
    return found.select(
        F.col("row.id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
