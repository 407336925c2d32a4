"""Document review at scale: recorded model replies to scores, fields and decisions."""

from papersieve.plans.review import review, review_replies, run_review
from papersieve.schema import Field, Question, ReviewSchema

__all__ = ["Field", "Question", "ReviewSchema", "review", "review_replies", "run_review"]
