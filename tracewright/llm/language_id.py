"""Language identification by compression.

For each language the most frequent words of a sample are the raw content of a
zstandard dictionary. A text is compressed once with each dictionary, in blocks that
all start from it, and the language with the smallest sum is chosen. Where the best
two sums lie close together, both are measured again with the optimal parser, and
a margin that stays narrow rejects the choice.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import column, record, steps
from tracewright.session import stage

UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII that is no letter separates words; bytes of other characters stay.
_BREAKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """`rows` labelled documents a language and `dictionary_bytes` of their words bound the model.

    Texts are measured in blocks of `block` bytes; a margin below `close` is measured
    again, one below `narrow` is rejected. Margins are shares of the second best size.
    """

    rows: int = 400
    dictionary_bytes: int = 65_536
    block: int = 4096
    close: float = 0.03
    narrow: float = 0.01


def has_letter(text: str | None) -> bool:
    return text is not None and any(m.group().isalpha() for m in _LETTER.finditer(text))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_BREAKS).split()


def held_out(doc_id: str = "doc_id", parts: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by `parts`; a null id counts as empty text, so it is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts == 0


@dataclass(frozen=True)
class Model:
    """Dictionary and number of sampled documents of each language."""

    dictionaries: dict[str, bytes]
    sampled: dict[str, int]
    settings: Settings

    def _compressors(self, strategy: int, least: int) -> dict[str, zstandard.ZstdCompressor]:
        out = {}
        for lang, content in self.dictionaries.items():
            params = zstandard.ZstdCompressionParameters.from_level(
                3, min_match=least, strategy=strategy, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=params)
            out[lang] = zstandard.ZstdCompressor(dict_data=words, compression_params=params)
        return out

    @cached_property
    def fast(self):
        return self._compressors(zstandard.STRATEGY_GREEDY, 4)

    @cached_property
    def fine(self):
        return self._compressors(zstandard.STRATEGY_BTOPT, 3)

    def sizes(self, text: str, fine: bool = False) -> dict[str, int]:
        data, step = b" ".join(words_of(text)), self.settings.block
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        return {lang: sum(len(c.compress(b)) for b in blocks) for lang, c in (self.fine if fine else self.fast).items()}

    def _order(self, sizes: dict[str, int]) -> list[str]:
        return sorted(sizes, key=lambda x: (sizes[x], -self.sampled[x], x))

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin, accepted. Equal sizes go to the language with more samples, then by name.

        The score is the share of the language when every byte saved doubles its weight.
        """
        if not self.dictionaries or not has_letter(text):
            return UNDETERMINED, 0.0, 0.0, False
        for fine in (False, True):
            sizes = self.sizes(text, fine)
            best, *others = self._order(sizes)
            margin = 1.0 - sizes[best] / sizes[others[0]] if others else 1.0
            if margin >= self.settings.close:
                break
        score = 1.0 / sum(2.0 ** -min(n - sizes[best], 1000) for n in sizes.values())
        return best, score, margin, margin >= self.settings.narrow


def _word_counts(batches):
    kinds = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
    for b in steps(batches):
        for lang, text in zip(column(b, "lang").to_pylist(), column(b, "text").to_pylist()):
            found = Counter(words_of(text))
            yield record(kinds, lang=[lang] * len(found), word=list(found), n=list(found.values()))


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Model of the rows with text and lang: per language the `rows` ids with the smallest hash, equal texts once.

    What reaches the driver are the dictionaries, `dictionary_bytes` a language. No rows give a model without languages.
    """
    ids = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"))
    # ranks of hashes fine enough that the last one taken holds few ids: a 64th of a power of two each, the smallest hashes highest
    share = F.shiftrightunsigned("hash", 11) / F.lit(2.0**53)
    ids = ids.withColumn("rank", F.floor(F.log2(share + 2.0**-54) * -64))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("rank")))
    cut = ids.groupBy("lang", "rank").agg(F.count(F.lit(1)).alias("n")).withColumn("before", upto - F.col("n"))
    cut = stage(cut.where(F.col("before") < settings.rows).groupBy("lang").agg(F.min("rank").alias("least")))
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    near = ids.join(cut, "lang").where(F.col("rank") >= F.col("least")).withColumn("_r", F.row_number().over(order))
    picked = stage(near.where(F.col("_r") <= settings.rows).select("doc_id", "lang").distinct())
    texts = labelled.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"], "left_semi").where("text IS NOT NULL")
    texts = stage(texts.select("lang", "text").distinct())
    counts = texts.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    common = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    fits = counts.withColumns({"place": F.row_number().over(common), "upto": F.sum(F.octet_length("word") + 1).over(common)})
    words = fits.where(F.col("upto") <= settings.dictionary_bytes).select("lang", "word", "place").collect()
    content: dict[str, list] = {}
    # the commonest word comes last, next to the text
    for r in sorted(words, key=lambda r: (r.lang, -r.place)):
        content.setdefault(r.lang, []).append(bytes(r.word) + b" ")
    sampled = {r.lang: r.n for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Model({k: b"".join(v) for k, v in content.items()}, {k: sampled[k] for k in content}, settings)


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns `keep` of every row with lang_pred, score (0 to 1), margin and accepted.

    A null text and one without a letter are `und` with score 0, so is every text
    under a model without languages. A rejected row still names its best language.
    Repeated rows get a row each; an empty table gives none.
    """
    fields = [docs.schema[c] for c in keep]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "lang_pred string, score double, margin double, accepted boolean"

    def run(batches):
        for b in steps(batches):
            found = [model.predict(t) for t in column(b, "text").to_pylist()]
            lang, score, margin, ok = map(list, zip(*found))
            yield pa.RecordBatch.from_arrays(
                [*[column(b, c) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(ok, pa.bool_())],
                names=[*keep, "lang_pred", "score", "margin", "accepted"])

    return docs.select(*keep, "text").mapInArrow(run, kinds)


def classify_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learn from the documents that are not held out, then predict all: doc_id, held_out, lang_pred, score, margin, accepted.

    `lang` is read for learning only. Null ids are held out and stay.
    """
    model = fit(docs.where(~held_out()), settings)
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, "doc_id", "held_out")
