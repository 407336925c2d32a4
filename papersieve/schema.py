"""The review schema: questions, fields, excluding questions and cutoff."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from papersieve import fixed_values as fv

QUESTION_TABLE = T.StructType([
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("question", T.StringType(), False),
    T.StructField("scores", T.ArrayType(T.DoubleType()), False),
])
FIELD_TABLE = T.StructType([
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
])
EXCLUDING_TABLE = T.StructType([
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("id", T.StringType(), False),
])

# Columns that reports carry beside those of their header.
KEY_COLUMNS = ("doc_id", "run_ts", "run_id")


@dataclass(frozen=True)
class Question:
    id: str
    question: str
    scores: tuple[float, ...]


@dataclass(frozen=True)
class Field:
    key: str
    description: str


@dataclass(frozen=True)
class ReviewSchema:
    """A validated questionnaire. It is small by nature and lives on the driver."""

    questions: tuple[Question, ...]
    fields: tuple[Field, ...]
    excluding: tuple[str, ...] = ()
    cutoff: float = 0

    def __post_init__(self) -> None:
        if not self.questions or not self.fields:
            raise ValueError("a review schema needs at least one question and one field")
        for label, names in (("question id", self.question_ids), ("field key", self.field_keys)):
            # column names of a table do not tell upper from lower case
            folded = [name.lower() for name in names]
            repeated = sorted({name for name in names if folded.count(name.lower()) > 1})
            if repeated:
                raise ValueError(f"{label} given more than once: {', '.join(repeated)}")
        self._check_columns()
        if isinstance(self.cutoff, bool) or not isinstance(self.cutoff, (int, float)):
            raise ValueError(f"the cutoff score must be a number, not {self.cutoff!r}")

    def _check_columns(self) -> None:
        """Names that no report could hold beside its other columns."""
        scores = {f"{i}{fv.SCORE_SUFFIX}".lower() for i in self.question_ids}
        taken = {*KEY_COLUMNS, fv.TOTAL_SCORE.lower()}
        for label, names, others in (
            ("question id", self.question_ids, taken | scores | {fv.TITLE.lower()}),
            ("field key", self.field_keys, taken),
        ):
            bad = sorted(name for name in names if name.lower() in others or "`" in name)
            if bad:
                raise ValueError(f"{label} not usable as a column: {', '.join(bad)}")

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> ReviewSchema:
        try:
            return cls(
                questions=tuple(
                    Question(str(q["id"]), str(q["question"]), tuple(q["scores"]))
                    for q in data.get("quality_assessment_questions") or ()
                ),
                fields=tuple(
                    Field(str(f["key"]), str(f["description"]))
                    for f in data.get("data_extraction_fields") or ()
                ),
                excluding=tuple(str(i) for i in data.get("excluding_questions") or ()),
                cutoff=data.get("cutoff_score", 0),
            )
        except KeyError as missing:
            raise ValueError(f"review schema entry without {missing}") from missing

    @classmethod
    def from_file(cls, path: str | Path) -> ReviewSchema:
        """Read a JSON file, or a YAML file where a YAML package is installed."""
        text = Path(path).read_text(encoding="utf-8")
        if str(path).lower().endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as absent:
                raise ValueError("reading a YAML schema needs the yaml package") from absent
            return cls.from_dict(yaml.safe_load(text) or {})
        return cls.from_dict(json.loads(text))

    @property
    def question_ids(self) -> list[str]:
        return [q.id for q in self.questions]

    @property
    def field_keys(self) -> list[str]:
        return [f.key for f in self.fields]

    def questions_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, q.id, q.question, [float(s) for s in q.scores])
            for i, q in enumerate(self.questions)
        ]
        return spark.createDataFrame(rows, QUESTION_TABLE)

    def fields_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f.key, f.description) for i, f in enumerate(self.fields)]
        return spark.createDataFrame(rows, FIELD_TABLE)

    def excluding_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.excluding)), EXCLUDING_TABLE)

    def qa_header(self) -> list[str]:
        """Columns of the quality report: title, each text with its score, total."""
        scored = [name for i in self.question_ids for name in (i, i + fv.SCORE_SUFFIX)]
        return report_header([fv.TITLE, *scored, fv.TOTAL_SCORE])

    def de_header(self) -> list[str]:
        """Columns of the extraction report: one per field."""
        return report_header(self.field_keys)

    def prompt(self) -> str:
        """The review prompt, the same for every document of one review."""
        questions = "".join(
            f"* {q.id}: {q.question} (Possible scores: {', '.join(str(s) for s in q.scores)})\n"
            for q in self.questions
        )
        fields = "".join(f"* {f.key}: {f.description}\n" for f in self.fields)
        return (
            fv.PROMPT_OPENING + questions + fv.PROMPT_FIELDS_HEADING + fields
            + fv.PROMPT_CUTOFF + str(self.cutoff) + fv.PROMPT_CLOSING
        )


def report_header(names: list[str]) -> list[str]:
    """Report columns; one that holds question columns always carries a title."""
    holds_questions = any(name.startswith("QE") for name in names)
    if holds_questions and fv.TITLE not in names:
        return [fv.TITLE, *names]
    return list(names)


def header_type(names: list[str]) -> T.StructType:
    """Table type of a report: scores are doubles, everything else is text.

    Scores are the total, those of ``QE`` questions and, in a quality report, which
    closes with the total, any named after its question. A field may be called
    ``RISK_SCORE``.
    """
    scores = {fv.TOTAL_SCORE}
    if names[-1:] == [fv.TOTAL_SCORE]:
        scores.update(name + fv.SCORE_SUFFIX for name in names)

    def scored(name: str) -> bool:
        return name in scores or (name.startswith("QE") and name.endswith(fv.SCORE_SUFFIX))

    return T.StructType([
        T.StructField(name, T.DoubleType() if scored(name) else T.StringType(), True)
        for name in names
    ])
