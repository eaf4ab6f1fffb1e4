"""Text rules for recognised tokens: clean-up, noise and category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.metadata import bind

# fixed values: look-alike letters and their Latin forms, raised and lowered characters
LOOKALIKES = ("АВСЕНКМОРТХасеортху", "ABCEHKMOPTXaceopTxy")
SMALL_FORMS = ("ₐₑₒₓₕₖₗₘₙₚₛₜ¹²³", "aeoxhklmnpst123")

# fixed values: rewrites in the order they apply (pattern, replacement)
REWRITES = (
    (r"[\"']+$", ""),
    (r"(?i),(?:LF|UF|Lit)$", "µF"),
    (r"^(\d+)\s+[uU]F$", "$1µF"),
    (r"^(\d+)\s+([KkMRPNFGpnΩ])$", "$1$2"),
    (r"(\d),(\d)", "$1.$2"),
    (r"^0(\d)$", "$1"),
    (r"^[O0](\p{Lu})$", "$1"),
    (r"^[Oo](\+[A-Za-z])", "$1"),
)
VALUE_BODY = r"^\d+\.?\d*[PNFUKRMGpnfukrmgΩ]$"
LATER_REWRITES = (
    (r"^I((?:SS|N)\d{3,5})$", "1$1"),
    (r"^0([1-9]\d{2})$", "D$1"),
    (r"^RB(\d{2,4})$", "R8$1"),
    (r"^Q[B8][O0](\d{1,3})$", "Q80$1"),
    (r"(\d\.)B", "$18"),
    (r"^LI(\d{2,3})$", "L1$1"),
    (r"^m(\d+\.?\d*[KkMRPNFUGpnfuΩ])$", "$1"),
    (r"^/$", "7"),
    (r"^(\d{1,3})[,.]$", "$1"),
    (r"^1C(\d{2,4})", "IC$1"),
)
# fixed values: the first of these that fits ends the clean-up (pattern, text put behind group 1)
ENDINGS = (
    (r"(?i)^(\d[\d.]*[PNFUKRΩ])M$", ""),
    (r"(?i)^([A-Z]{1,3}\d*)=", ""),
    (r"(?i)^((?:IC|[RCLQ])\d{2,3})\d+[KMPRNUF]", ""),
    (r"^(\d{2,})\.00$", "Ω"),
    (r"^(\d[\d.]*[kKM]?)[goQ]$", "Ω"),
    (r"^(\d{2,3})52$", "Ω"),
    (r"^(?!2S$)(\d[\d.]*[kKmMGg]?)[sS][23]?$", "Ω"),
)
COMPOUND_EQ = r"(?i)^([A-Z]{1,3}\d*)="
COMPOUND_NOEQ = r"(?i)^((?:IC|[RCLQ])\d{2,3})\d+[KMPRNUF]"


def _rewrite(text: Column, rules) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, text)


def _digits_for_letters(text: Column) -> Column:
    """`1O0K` to `100K`, `S6K` to `56K`, only where the result is a value."""
    def ones(t: Column) -> Column:
        c = F.translate(t, "IO", "10")
        return F.when((c != t) & c.rlike(VALUE_BODY), F.upper(c)).otherwise(t)

    def fives(t: Column) -> Column:
        c = F.translate(t, "Ss", "55")
        return F.when((c != t) & c.rlike(VALUE_BODY), c).otherwise(t)

    return bind(bind(text, ones), fives)


def _model_digits(text: Column) -> Column:
    fixed = lambda t: F.concat(F.substring(t, 1, 3), F.translate(F.substr(t, F.lit(4)), "IOlo", "1010"))
    return bind(text, lambda t: F.when(t.rlike(r"^2S[A-Z][\dIOlo]+$"), fixed(t)).otherwise(t))


def _end(t: Column) -> Column:
    out = None
    for pattern, tail in ENDINGS:
        hit = F.concat(F.regexp_extract(t, pattern, 1), F.lit(tail))
        out = F.when(t.rlike(pattern), hit) if out is None else out.when(t.rlike(pattern), hit)
    return out.otherwise(F.regexp_replace(t, r"\.{2,4}", "~"))


def clean(text: Column) -> Column:
    """Repair typical misreadings, rule after rule."""
    for source, plain in (LOOKALIKES, SMALL_FORMS):
        text = F.translate(text, source, plain)
    text = _digits_for_letters(_rewrite(text, REWRITES))
    text = _model_digits(F.regexp_replace(text, r"^25([A-Z]\d{3,4})$", "2S$1"))
    return bind(_rewrite(text, LATER_REWRITES), _end)


# fixed values: model numbers of semiconductors and integrated circuits
SEMI_MODEL = r"(?i)^(?:2S[ABCDKJ]|2N|1S[SN]?|1N|B[CDFRUY]|TIP|IRF|MPS[AU]?|MJE?|MA)\d{2,5}[A-Z]{0,2}$"
SEMI_VALUE = r"(?i)^(2S[ABCD]|1S[SN]|B[CDFRU]|MA)\d{2,5}[A-Z]{0,2}$"
IC_VALUE = r"(?i)^(UL|TDA|TL|LM|NE|UA|UPC|MC|TA|AN|AD|OP|MAX|LF|CA)\d{2,5}[A-Z]{0,2}$"


def _value_shaped(t: Column) -> Column:
    pin_name = t.rlike(r"^[A-Za-z]{2}[\p{L}\p{N}]*$") & ~t.rlike(r"^[A-Za-z]+\d+$")
    return (
        F.when(t.rlike(SEMI_VALUE) | t.rlike(IC_VALUE), True)
        .when(pin_name, False)
        .otherwise(t.rlike(r"[KMRΩUNPFV.,/]|OHM") | t.rlike(r"\d.*\d"))
    )


def looks_like_value(text: Column) -> Column:
    return bind(F.trim(text), _value_shaped)


def category(text: Column) -> Column:
    """component, value, net_label or other; the first rule that fits decides."""
    return bind(F.trim(text), _category)


def _category(t: Column) -> Column:
    up = F.upper(t)
    component = (
        up.rlike(r"^IC\d+$") | t.rlike(r"^[RCLQDMT]p[LP]$") | up.rlike(r"^[RCLQDMTS]\d+[A-Z]?$") | up.rlike(r"^SF\d{2,4}$")
    )
    bare = F.regexp_replace(up, "[_-]", "")
    stripped = F.regexp_replace(up, "[+/_-]", "")
    word = r"^[\p{L}\p{N}]+$"
    return (
        F.when(t == "", "other")
        .when(component, "component")
        .when(up.rlike(r"^[+\-]?\d+V$"), "net_label")
        .when(t.rlike(r"\d") & _value_shaped(t), "value")
        .when(bare.rlike(word) & (F.length(up) <= 6), "net_label")
        .when(t.rlike(r"(?i)^[LR]\s+ch$"), "net_label")
        .when(stripped.rlike(word) & F.length(up).between(2, 6), "net_label")
        .otherwise("other")
    )


def pin_count(text: Column) -> Column:
    """n when the text is the numbers 1..n run together and n >= 3, else null.

    The length alone fixes n, so one comparison decides.
    """
    return bind(text, _pin_count)


def _pin_count(text: Column) -> Column:
    n = F.length(text)
    last = (
        F.when(n <= 9, n)
        .when(n <= 189, (F.floor((n - 9) / 2) + 9).cast("int"))
        .otherwise((F.floor((n - 189) / 3) + 99).cast("int"))
    )
    spelled = F.array_join(F.sequence(F.lit(1), F.greatest(last, F.lit(1))).cast("array<string>"), "")
    return F.when(text.rlike(r"^\d{3,}$") & (spelled == text), last)


# fixed values: texts that are always or often noise
STOP_WORDS = ("THE", "AND", "FOR", "NOT", "BUT", "ARE", "HAS", "HAD")
ALWAYS_NOISE = ("+", "-", "~", "m", "M", "=", ":", "00", "#")


def is_noise(text: Column, w: Column, h: Column, confidence: Column, floor: Column | float) -> Column:
    """Below the confidence floor without a rescuing shape, or one of the noise shapes."""
    limit = F.lit(floor) if not isinstance(floor, Column) else floor
    return bind(text, lambda t: _noise(t, w, h, confidence, limit))


def _noise(text: Column, w: Column, h: Column, confidence: Column, floor: Column) -> Column:
    rescued = (
        ((confidence >= 25) & text.rlike(r"^\d+\.?\d*[KkMRPNFUGpnfuΩ]{1,2}$"))
        | ((confidence >= 15) & text.rlike(r"^\d+\.?\d*µF$"))
        | ((confidence >= 40) & text.rlike(r"^\d{1,2}$"))
        | ((confidence >= 40) & text.rlike(r"^\d{1,3}\s+\d{1,3}$"))
    )
    up, n = F.upper(text), F.length(text)
    area, side = w * h, F.greatest(w, h)
    thin = lambda share: area < F.lit(share) * side * side
    shape = (
        text.isin(*ALWAYS_NOISE) | up.isin(*STOP_WORDS) | up.isin("77", "777")
        | ((text == "+/-") & thin(0.02)) | (area < 1.0)
        | ((n <= 2) & ~text.rlike(r"[\p{L}\p{N}]") & thin(0.05))
        | (up.rlike(r"^[7MW]{1,3}$") & thin(0.002))
        | text.rlike(r"^[IlT|]{2,4}$")
        | ((text == "1") & (confidence < 45))
        | (text.isin("O", "0", "o", "C", "c") & (confidence < 55))
        | (text.isin("W", "Y") & (confidence < 80))
        | ((text == "MA") & (confidence < 55))
        | text.rlike(r"^\**$")
        | (text.rlike(r"^\d{6,}$") & pin_count(text).isNull())
    )
    return ((confidence < floor) & ~rescued) | shape
