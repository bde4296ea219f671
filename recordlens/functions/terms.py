"""Search terms, fields and table names of the programme data."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Search terms, in the order results list them.
BROAD_TERMS = (
    r"\bAI\b", r"\bA\.I\.\b", "人工知能", "じんこうちのう",
    "機械学習", "きかいがくしゅう", "マシンラーニング", r"\bML\b",
    "深層学習", "しんそうがくしゅう", "ディープラーニング", "Deep Learning",
    "ニューラルネットワーク", "Neural Network", r"\bNN\b",
    "自然言語処理", "しぜんげんごしょり", r"\bNLP\b", "Natural Language Processing",
    "テキストマイニング", "Text Mining",
    "ビッグデータ", "Big Data", "ビッグ・データ",
    "データマイニング", "Data Mining", "データ解析", "データ分析",
    "予測分析", "予測モデル", "アルゴリズム", "Algorithm",
    "統計的学習", "パターン認識",
    "RPA", "Robotic Process Automation", "ロボティック・プロセス・オートメーション",
    "自動化", "じどうか", "オートメーション", "Automation",
    "ロボット", "Robot", "ロボティクス", "Robotics",
    "IoT", "Internet of Things", "モノのインターネット",
    "スマート", "Smart", "インテリジェント", "Intelligent",
    "センサー", "Sensor", "センシング",
    "DX", "デジタルトランスフォーメーション", "Digital Transformation",
    "デジタル変革", "デジタル化",
    "画像認識", "がぞうにんしき", "Image Recognition", "コンピュータビジョン", "Computer Vision",
    "音声認識", "おんせいにんしき", "Voice Recognition", "Speech Recognition",
    "チャットボット", "Chatbot", "ボット", r"\bBot\b",
    "レコメンド", "Recommendation", "推薦システム",
    "生成AI", "Generative AI", "ChatGPT", "GPT", "LLM", "大規模言語モデル",
    "Transformer", "BERT", "機械翻訳", "Machine Translation",
)
STRICT_TERMS = (r"\bAI\b", r"\bA\.I\.\b")
CURRENT_PATTERNS = (r"\bAI\b",)
RELAXED_PATTERNS = ("AI", "ＡＩ", r"A\.I\.", r"Ａ\.Ｉ\.")
COMPOUND_PATTERNS = (
    "生成AI", "生成ＡＩ", r"AI[ア-ン\w]*", r"ＡＩ[ア-ン\w]*", r"[ア-ン\w]*AI", r"[ア-ン\w]*ＡＩ",
)
# Strict patterns and the folded texts a hit must have.
EXACT_PATTERNS = (
    r"\bAI\b", r"\bＡＩ\b", r"(?<![a-zA-Z])AI(?![a-zA-Z])", r"(?<![ａ-ｚＡ-Ｚ])ＡＩ(?![ａ-ｚＡ-Ｚ])",
)
EXACT_TEXTS = ("AI", "ＡＩ")

# The searched fields per table.
SEARCH_FIELDS = {
    "projects": ("事業名", "事業の目的", "事業の概要", "現状・課題"),
    "expenditure_info": ("支出先名", "契約概要", "費目", "使途"),
    "goals_performance": ("アクティビティ／活動目標／成果目標", "活動指標／成果指標"),
    "expenditure_connections": ("支出先の支出先ブロック名", "資金の流れの補足情報"),
    "contracts": (
        "契約先名（国庫債務負担行為等による契約）",
        "契約概要（契約名）（国庫債務負担行為等による契約）",
    ),
}
# Names under which the entity key may appear, in order of preference.
KEY_ALIASES = ("予算事業ID", "予算事業コード", "事業ID")
# ---------------------------------------------------------------------------

# Optional runs at either end of a pattern: they do not change whether it occurs.
_OPTIONAL = re.compile(r"^\[[^\]]*\]\*|\[[^\]]*\]\*$")
# A plain text, with escaped full stops, perhaps between word boundaries.
_PLAIN = re.compile(r"(\\b)?((?:[^\\^$.|?*+()\[\]{}]|\\\.)+?)(\\b)?")
# Characters beyond the Latin blocks.
_BEYOND_LATIN = r"[^\x00-\x{24F}]"
_LAST_LATIN = 0x24F


def key_column(columns: list[str], aliases: tuple[str, ...] = KEY_ALIASES) -> str | None:
    """The entity key of a table, by the first alias present."""
    return next((a for a in aliases if a in columns), None)


def java_pattern(pattern: str) -> str:
    """The pattern with case folding and word classes for all of Unicode."""
    return f"(?iuU){pattern}"


def fold(text: Column) -> Column:
    """Lower case, with the letters that case folding maps onto i, s and k."""
    letters = "İıſK"
    special = F.lit(False)
    for c in letters:
        special = special | text.contains(c)
    return F.lower(F.when(special, F.translate(text, letters, "iisk")).otherwise(text))


def with_folded(cells: DataFrame) -> DataFrame:
    """Add what :func:`occurs_sql` tests: the folded text, and whether it leaves the Latin blocks."""
    return cells.withColumn("_folded", fold(F.col("text"))).withColumn(
        "_beyond", F.col("_folded").rlike(_BEYOND_LATIN)
    )


def sql_text(value: str) -> str:
    """A text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def occurs_sql(pattern: str) -> str:
    """SQL test whether a pattern occurs in ``text``, ignoring case.

    Plain terms are a substring test on the folded text, which a term beyond the Latin
    blocks takes only where the text has such characters. Between word boundaries the
    same test spares most texts the regular expression. Given as SQL, because a column
    object per step makes long term lists slow to build.
    """
    regex = f"rlike(text, {sql_text(java_pattern(pattern))})"
    plain = _PLAIN.fullmatch(_OPTIONAL.sub("", pattern))
    if plain is None:
        return regex
    before, term, after = plain.groups()
    term = term.replace("\\.", ".").lower()
    found = f"contains(_folded, {sql_text(term)})"
    if any(ord(c) > _LAST_LATIN for c in term):
        found = f"_beyond AND {found}"
    return f"({found} AND {regex})" if before or after else f"({found})"


def any_occurs(patterns: Sequence[str]) -> Column:
    """Whether some pattern occurs in ``text``."""
    return F.expr(" OR ".join(occurs_sql(p) for p in patterns) or "false")
