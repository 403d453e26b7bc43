"""Rule-based classes of memories and of queries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallkit import config

#: The expressions whose matches are counted, by class.
EPISODIC_FORMS = (
    r"した[。、。\s」\)]", "しました", "決めた", "決定した", "完了した", "終わった", "やった", "行った", "実行した",
    "作成した", "修正した", "対応した", "リリースした", "デプロイした", "確認した", "実施した", "達成した", "開始した",
    "終了した", "失敗した", "成功した", "was done", "was completed", "decided",
)
SEMANTIC_FORMS = (
    "とは", "という", "の仕様", "の概要", "の定義", "について", "を指す", "を意味する", "とは何",
    "is defined as", "refers to", "is a type of", "is an abbreviation", "stands for", "# ", "## ",
)
PROCEDURAL_FORMS = (
    "する方法", "のやり方", "手順", "ステップ", r"step \d+", r"^\d+\. ", r"^\$ ", r"^> ", "```", "how to",
    "instructions", "procedure",
)
#: Every form that is not ASCII holds one of these letters.
JAPANESE = "[\u3041-\u30ff\u4e00-\u9fff]"
TIME_FORM = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|昨日|今日|先週|先月|今週"
COMMAND_FORM = r"^\$\s+\S+|^>\s+\S+|^\d+\.\s+\S+"
#: Intents of queries.
ERROR_FORM = r"ERROR|WARN|Exception|Error|TypeError|SyntaxError|ValueError|ENOENT|ECONNREFUSED|ETIMEDOUT|ER_\w+|ORA-\d+"
CAUSE_FORM = r"なぜ|どうして|原因|理由|何故|why|cause|reason|how did"
WHEN_FORM = (
    r"昨日|今日|明日|先週|来週|先月|今月|来月|最近|\d+\s*日?前|先\s*\d+\s*日|yesterday|today|tomorrow|last\s+week|"
    r"next\s+week|last\s+month|recently|\d+\s*days?\s+ago|previous\s+week"
)

PENALTY = 0.5
DEFAULT_IMPORTANCE = 0.5


def _count(text: Column, forms: tuple[str, ...], flags: str = "") -> Column:
    """Matches of the forms; texts without Japanese letters are held against the ASCII forms only."""
    every, plain = ("|".join(f) for f in (forms, [x for x in forms if x.isascii()]))
    japanese = text.rlike(JAPANESE)
    return F.when(japanese, F.regexp_count(text, F.lit(flags + every))).otherwise(
        F.regexp_count(text, F.lit(flags + plain))
    )


def _tagged(text: Column, kind: str) -> Column:
    plain = F.contains(F.lower(text), F.lit(f"[{kind}]"))
    return (F.contains(F.lower(text), F.lit(config.TYPE_TAGS[kind].lower())) | plain).cast("int") * 10.0


def class_scores(text: Column, source_type: Column) -> dict[str, Column]:
    commands = F.regexp_count(text, F.lit("(?Umd)" + COMMAND_FORM))
    return {
        "episodic": _tagged(text, "episodic")
        + (source_type == "conversation").cast("int") * 3.0
        + _count(text, EPISODIC_FORMS, "(?iU)") * 2.0
        + text.rlike(f"(?U)(?=[\\d昨今先])(?:{TIME_FORM})").cast("int") * 2.0,
        "semantic": _tagged(text, "semantic")
        + (source_type == "url").cast("int") * 2.0
        + _count(text, SEMANTIC_FORMS) * 1.5,
        "procedural": _tagged(text, "procedural")
        + _count(text, PROCEDURAL_FORMS, "(?iUmd)") * 1.5
        + F.when(commands >= 2, commands * 2.0).otherwise(0.0),
    }


def _verdict(scores: Column) -> Column:
    best = F.greatest(scores["episodic"], scores["semantic"], scores["procedural"])
    fallback = best < 1.0
    kind = (
        F.when(fallback, "episodic")
        .when(scores["procedural"] == best, "procedural")
        .when(scores["semantic"] == best, "semantic")
        .otherwise("episodic")
    )
    return F.struct(
        kind.alias("memory_type"),
        F.when(fallback, DEFAULT_IMPORTANCE * PENALTY).otherwise(DEFAULT_IMPORTANCE).alias("importance"),
        fallback.alias("is_fallback"),
        F.when(fallback, 0.0).otherwise(best / (best + 1e-9)).alias("confidence"),
    )


def classify(text: Column, source_type: Column) -> Column:
    """``memory_type, importance, is_fallback, confidence``; ties go to procedural, then semantic."""
    scores = F.struct(*[score.alias(kind) for kind, score in class_scores(text, source_type).items()])
    # passed as a lambda's argument, the scores are worked out once
    return F.transform(F.array(scores), _verdict)[0]


def analyze_query(text: Column) -> Column:
    """Weights, depth and decay flag that suit a query; errors outrank causes."""
    error, cause = text.rlike("(?iU)" + ERROR_FORM), text.rlike("(?iU)" + CAUSE_FORM)

    def pick(if_error, if_cause, otherwise) -> Column:
        return F.when(error, F.lit(if_error)).when(cause, F.lit(if_cause)).otherwise(F.lit(otherwise))

    return F.struct(
        pick(0.2, 0.2, 0.5).alias("vector_weight"),
        pick(0.6, 0.1, 0.2).alias("keyword_weight"),
        pick(0.2, 0.7, 0.3).alias("graph_weight"),
        pick(1, 3, 2).alias("depth"),
        text.rlike("(?iU)" + WHEN_FORM).alias("time_decay"),
    )
