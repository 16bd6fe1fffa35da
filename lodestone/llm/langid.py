"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of training texts. A text is encoded with
every dictionary, and the one that gives the fewest bytes names its language; where the second is
no larger the decision is rejected. Every text, whatever its length, is encoded COPIES times over, so that
one too short to be shortened once (it would be stored as it is, and tie) still shows what a dictionary saves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.batches import map_in_arrow

PREDICTED = "doc_id long, lang_pred string, score double, margin double, rejected boolean"
UNKNOWN = "und"
LEVEL, COPIES = 5, 4


def held_out(id_column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4. A null id is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def learn(documents: DataFrame, texts_per_language: int = 800, dictionary_bytes: int = 98304, excerpt_chars: int = 400, max_texts: int = 100_000, total_bytes: int = 64_000_000) -> dict[str, bytes]:
    """A dictionary for each language of the training rows (non-null lang, not held out), however many.

    The sample is bounded: about `texts_per_language` rows of each language by a hash of id and text, equal rows once, fewer if
    there are so many languages that more than `max_texts` rows would be read in all, but one at least; one
    excerpt of `excerpt_chars` code points each, from a place in the text that the hash picks. The driver
    gets a row per language and the sample, at most `texts_per_language` rows of each. Dictionaries are of `dictionary_bytes` bytes, or of an equal share
    of `total_bytes` if that is less, so that what is sent to the executors is bounded."""
    train = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    h = F.xxhash64(F.col("doc_id").cast("long"), "text")
    counts = {r["lang"]: r for r in train.groupBy("lang").agg(F.approx_count_distinct(h).alias("n"), F.min(h).alias("least")).collect()}
    if not counts:
        return {}
    each, wide = max(1, min(texts_per_language, max_texts // len(counts))), 1 << 63
    bounds = [(lang, max(r["least"], min(wide - 1, int(2 * wide * 1.2 * each / r["n"]) - wide))) for lang, r in counts.items()]
    bounds = F.broadcast(documents.sparkSession.createDataFrame(bounds, "lang string, bound long"))  # a row per language
    place = F.lit(1) + F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(1)), F.greatest(F.length("text") - excerpt_chars, F.lit(1)).cast("long")).cast("int")
    chosen = train.select("lang", h.alias("h"), "doc_id", F.substring("text", place, F.lit(excerpt_chars)).alias("excerpt")).join(bounds, "lang").filter("h <= bound")
    chosen = chosen.select("lang", "h", "doc_id", "excerpt").distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "excerpt"))).filter(F.col("place") <= each)
    own: dict[str, list[tuple]] = {lang: [] for lang in counts}
    for r in chosen.collect():
        own[r["lang"]].append((r["h"], r["doc_id"], r["excerpt"]))
    return dictionaries({lang: [x for *_, x in sorted(rs)[:each]] for lang, rs in own.items()}, max(1, min(dictionary_bytes, total_bytes // len(counts))))


def dictionaries(excerpts: dict[str, list[str]], dictionary_bytes: int) -> dict[str, bytes]:
    """A dictionary per language. Two halves of the excerpts judge each other, and those that the
    other half gives to another language (mixed or mislabelled texts) are left out."""
    folded = {lang: list(dict.fromkeys(fold(x) for x in xs)) for lang, xs in excerpts.items()}
    join = lambda xs: b"\n".join(xs)[-dictionary_bytes:]
    kept: dict[str, list[bytes]] = {lang: [] for lang in folded}
    for side in (0, 1):
        judge = Classifier({lang: join(xs[1 - side :: 2]) for lang, xs in folded.items()}, LEVEL, 1.0)
        for lang, xs in folded.items():
            kept[lang] += [x for x in xs[side::2] if judge.decide(judge.sizes(x))[0] == lang]
    return {lang: join(kept[lang] or folded[lang]) for lang in folded}


def fold(text: str) -> bytes:
    """What is compressed: the whole text in small letters."""
    return text.lower().encode()


class Classifier:
    """Compressors for each language, made once per process."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, temperature: float):
        self.langs = sorted(dictionaries)
        self.temperature = temperature
        self.press = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.press.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_dict_id=False, write_checksum=False))

    def sizes(self, text: bytes) -> list[int]:
        """Encoded bytes of COPIES copies of a text under each dictionary."""
        return [self._size(p, text + b" ") for p in self.press]

    @staticmethod
    def _size(press: zstandard.ZstdCompressor, text: bytes) -> int:
        stream = press.compressobj(size=COPIES * len(text))
        return sum(len(stream.compress(text)) for _ in range(COPIES)) + len(stream.flush())

    def decide(self, sizes: list[int]) -> tuple[str, float, float]:
        """Language, probability, and the margin to the second in bytes."""
        x = np.array(sizes, float)
        best = int(x.argmin())
        p = np.exp2(-8 * self.temperature * (x - x[best]))
        margin = float(np.partition(x, 1)[1] - x[best]) if len(x) > 1 else float(len(x))
        return self.langs[best], float(p[best] / p.sum()), margin


def _predict(dictionaries: dict[str, bytes], level: int, temperature: float, min_margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries, level, temperature)
        for batch in batches:
            rows: list[tuple] = []
            for text, letters in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not letters or not model.langs:
                    rows.append((UNKNOWN, 0.0, 0.0, True))
                    continue
                lang, score, margin = model.decide(model.sizes(fold(text)))
                rows.append((lang, score, margin, margin < min_margin))
            lang, score, margin, rejected = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], [batch.schema.names[0], "lang_pred", "score", "margin", "rejected"])

    return run


def identify(documents: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, temperature: float = 0.05, min_margin: float = 1.0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`PREDICTED` for the whole text of every row.

    A text that is null or has no letter is `und`, rejected, with score 0; so is every text if no
    dictionary was learnt. Other texts get the learnt language of the smallest encoding (ties to the
    first by name), and are rejected, though named, if the next is less than `min_margin` bytes larger:
    an absolute number, since past the first kilobytes a text's own history serves it as well as any
    dictionary, and the difference stays however long it is. `margin` is that difference. Repeated rows get equal rows, null ids stay null, other columns are ignored."""
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), _letters(text_column))
    return map_in_arrow(rows, _predict(dictionaries, level, temperature, min_margin), PREDICTED)


def _letters(text_column: str) -> Column:
    return F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False)).alias("letters")


def decide(documents: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, temperature: float = 0.05, min_margin: float = 1.0) -> DataFrame:
    """`row`, a struct of all columns of `documents` (text among them), beside the columns of `identify`."""
    kind = documents.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    rows = documents.select(F.struct("*").alias("row"), "text", _letters("text"))
    return map_in_arrow(rows, _predict(dictionaries, level, temperature, min_margin), PREDICTED.replace("doc_id long", f"row {kind}"))
