"""The review schema that the registered queries use."""

from papersieve import ReviewSchema

# Allowed scores of the questions, in order.
ALLOWED_SCORES = [
    [0.0, 0.5, 1.0], [0.0, 1.0, 2.0], [0.0, 0.5, 1.0], [0.0, 0.5, 1.0],
    [0.0, 1.0], [0.0, 1.0], [0.0, 1.0], [0.0, 0.5, 1.0],
]
_ASKED = [
    "Is the text prose rather than a list, a table or code?",
    "How much of the text is left when repeated lines are taken out?",
    "Is the whole text in one language?",
    "Does the text name where it comes from?",
    "Is it free of license lines?",
    "Is it free of names, numbers and addresses of persons?",
    "Could the text stand alone, without the page around it?",
    "Would a careful editor let the spelling pass?",
]
_WANTED = {
    "TITLE": "First line that reads like a heading.",
    "AUTHOR": "Person or site that signs the text.",
    "YEAR": "Latest year that the text mentions.",
    "SOURCE": "Site or collection that the text was taken from.",
    "VISION SYSTEM": "Any camera in the text, as it is called there.",
    "LICENSE": "License that the text states.",
}

_DECIDED_BY = {"cutoff_score": 6.5, "excluding_questions": ["QE1", "QE7", "QE8"]}

SCHEMA = ReviewSchema.from_dict({
    "quality_assessment_questions": [
        {"id": f"QE{k}", "question": question, "scores": scores}
        for k, (question, scores) in enumerate(zip(_ASKED, ALLOWED_SCORES), 1)
    ],
    **_DECIDED_BY,
    "data_extraction_fields": [
        {"key": key, "description": text} for key, text in _WANTED.items()
    ],
})

# A later questionnaire: fewer of the questions, a new one, other fields.
LATER_SCHEMA = ReviewSchema.from_dict({
    "quality_assessment_questions": [
        {"id": q.id, "question": q.question, "scores": list(q.scores)} for q in SCHEMA.questions[4:]
    ] + [{"id": "QE9", "question": "Would you read it again?", "scores": [0.0, 1.0]}],
    **_DECIDED_BY,
    "data_extraction_fields": [
        {"key": key, "description": text} for key, text in [*list(_WANTED.items())[2:], ("COUNTRY", "Where it was written.")]
    ],
})
