"""Label domains, record schemas and the unknown value."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The closed label domains, in their order, and the value for "not known" that every attribute allows.
UNKNOWN = "미확인"
DOMAINS: dict[str, tuple[str, ...]] = {
    "매운맛": ("없음", "약함", "보통", "강함"),
    "국물": ("국물요리", "국물약간", "국물없음"),
    "제공온도": ("뜨거움", "따뜻함", "상온", "차가움"),
    "조리법": ("끓임", "볶음", "구이", "튀김", "찜", "조림", "부침", "오븐", "비조리", "혼합"),
    "기름짐": ("낮음", "보통", "높음"),
    "든든함": ("가벼움", "보통", "든든함"),
}
CUISINES = ("한식", "중식", "일식", "양식", "동남아", "분식")
SNACK = ("예", "아니오")
#: All attributes that a condition can name: labelled ones and the two that rules derive.
ATTRIBUTES: dict[str, tuple[str, ...]] = {**DOMAINS, "계열": CUISINES, "안주": SNACK}
NOT_APPLICABLE = "해당없음"

CONDITION = T.StructType(
    [
        T.StructField("attribute", T.StringType()),
        T.StructField("allowed", T.ArrayType(T.StringType())),
        T.StructField("strength", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("rule", T.StringType()),
    ]
)
JUDGMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("query", "criterion", "id", "name", "company", "representative", "category", "grade", "source", "review", "note")])
FEEDBACK = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("query", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("menu", T.StringType()),
        T.StructField("place_id", T.StringType()),
        T.StructField("liked", T.IntegerType()),
        T.StructField("chosen", T.IntegerType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("representative", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("review", T.StringType()),
        T.StructField("label_source", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


@dataclass(frozen=True)
class Condition:
    """``attribute`` must (hard) or should (soft) have one of ``allowed``."""

    attribute: str
    allowed: tuple[str, ...]
    strength: str = "hard"
    evidence: str = ""
    rule: str = ""


@dataclass
class QuerySpec:
    """The five parts of a query (hard, soft, menu, excluded, context) and what was not used of its text."""

    text: str = ""
    hard: list[Condition] = field(default_factory=list)
    soft: list[Condition] = field(default_factory=list)
    menu_terms: list[str] = field(default_factory=list)
    menu_exclusions: list[dict] = field(default_factory=list)
    context_terms: list[dict] = field(default_factory=list)
    unhandled: list[dict] = field(default_factory=list)
    ignored: list[dict] = field(default_factory=list)
    contradictions: list[dict] = field(default_factory=list)
