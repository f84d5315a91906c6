"""Byte-level BPE by the tiktoken library with a rank file of one's own.

The file is read once, on the driver, and broadcast; each task builds the library's encoding from it. A long text is cut first, at places where
every match of the pattern ends whatever stands around them: before white space that follows something else, and between a letter or
digit of an old script and a punctuation mark. So the parts are encoded one by one and joined, and no part but a run without such a place is
longer than PART and the way to the next one. The library's pattern gives up on very long white space, so a run of more than BLANK
characters is cut by hand as the pattern would cut it: what stands before another word keeps its last character for that, the rest is one match.

Decoding joins the raw bytes of the tokens; nothing is replaced, so the bytes are those of the text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.shared import documents, tidy
from marlstone.llm.shingles import slices

#: Characters of a part of a long text, and of a run of white space that is cut by hand.
PART, BLANK = 1 << 17, 1 << 15
#: A cut behind this never parts a match. Blocks whose letters are letters in every version of Unicode that libraries have.
SAFE = regex.compile(
    r"[^\p{White_Space}](?=\p{White_Space})|[0-9A-Za-zÀ-ÖØ-öа-яԱ-Ֆא-תअ-हぁ-ゔァ-ヺ一-龥가-힣](?=[!-/:-@\[-`{-~、。])"
)
BLANKS = regex.compile(rf"\p{{White_Space}}{{{BLANK},}}")


class RankCoder:
    """The library's encoding for ranks and a pattern, for texts of any length."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.words = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= BLANK:
            return np.array(self.words.encode_ordinary(text), np.uint32)
        return np.concatenate([np.array((self.whole if one else self.words).encode_ordinary(p), np.uint32) for p, one in self.parts(text)])

    @staticmethod
    def parts(text: str, most: int = PART) -> Iterator[tuple[str, bool]]:
        """Parts that no match crosses, and whether one is a match by itself."""
        at = 0
        while at < len(text):
            cut = SAFE.search(text, at + most) if len(text) - at > most else None
            end = cut.end() if cut else len(text)
            for run in BLANKS.finditer(text, at, end):
                first, last = run.span()
                last -= last < len(text)  # a run that goes on to the end of the text is one match
                if at < first:
                    yield text[at:first], False
                yield text[first:last], True
                at = last
            if at < end:
                yield text[at:end], False
            at = end

    def decode(self, ids: np.ndarray) -> bytes:
        return self.words.decode_bytes(ids.tolist())


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a file of lines ``base64 rank``, by Spark's reader if the path has a scheme, else from the driver's disk."""
    if "://" in path:
        lines = [r["value"].encode() for r in spark.read.text(path).collect()]
    else:
        with open(path, "rb") as f:
            lines = f.read().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def rank_round_trip(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", packed: bool = False, keep: list[str] | None = None) -> DataFrame:
    """df with ``ids`` of the whole text and ``decoded``, the raw bytes of these ids again.

    ranks: a rank file of the tiktoken format, as large as a vocabulary (about a MB); pattern: the pattern that splits texts, each match of which is encoded
    separately. Strings that other vocabularies take for special tokens are ordinary text. ids is array<int>, or if packed the ids as binary, four bytes
    each, least one first. A null text counts as empty: no ids, no bytes. Rows are kept one by one, repeated ones too, with the
    columns ``keep`` (None: all); columns named as the new ones are replaced. Texts may have any length; no rows give no rows. Nothing is shuffled.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(spark, ranks))
    kept = [c for c in df.columns if c not in (ids, decoded) and (keep is None or c in keep)]
    df = df.select(*kept, F.col(text).alias("_text"))
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    schema = T.StructType([*df.schema.fields[:-1], T.StructField(ids, kind), T.StructField(decoded, T.BinaryType())])
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for b in batches:
            coder = coder or RankCoder(shared.value, pattern)
            for first, last, _, _ in slices(b.column(len(kept))):
                part = b.slice(first, last - first)
                found = [coder.encode(t or "") for t in part.column(len(kept)).to_pylist()]
                if packed:
                    new = pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())
                else:
                    at = np.zeros(len(found) + 1, np.int32)
                    np.cumsum([len(x) for x in found], out=at[1:])
                    new = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], new, pa.array(map(coder.decode, found), pa.binary())], names=names)

    return df.mapInArrow(tidy(work), schema)


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = rank_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packed=True, keep=["doc_id"])
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
