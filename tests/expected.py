"""What a reply must be read as, one reply at a time, for comparison in tests.

Written from the rules with Python's own ``re``, apart from the column
expressions under test, and used on small fixtures only.
"""

import re

# Patterns as the rules state them, in Python's spelling.
MARKED_ITEM = re.compile(r"(QE\d+):\s*(.*?)(?:\s*|\n)\1_SCORE:\s*([0-9.]+)", re.DOTALL)
UNMARKED_ITEM = re.compile(
    r"(QE\d+)[:\.]?\s*(.*?)\s*(?:QE\d+\s*Score|QE\d+Score|QE\d+_SCORE)[:\.]?\s*([0-9.]+)",
    re.DOTALL,
)
FIELD = re.compile(
    r"([A-Z][A-Z\s]+(?:\sOF\s[A-Z]+)?)\s*:\s*(.*?)(?=\s+[A-Z][A-Z\s]+(?:\sOF\s[A-Z]+)?:|$)",
    re.DOTALL,
)
LOOSE_TITLE = re.compile(r"TITLE\s*:(.*?)(?=\s[A-Z]{2,}|$)", re.IGNORECASE | re.DOTALL)
QUESTION = re.compile(r"QE\d+:")
STOPS = ("Minimum acceptance score", "SECTION 3", "Cutoff Score", "\n\n\n")


def _between(text, name):
    _, opened, rest = text.partition(f"=={name}_START==")
    inner, closed, _ = rest.partition(f"=={name}_END==")
    return inner.strip() if opened and closed else None


def _float(text):
    try:
        return float(text)
    except ValueError:
        return None


def _by_position(section):
    mentions = [m.group()[:-1] for m in QUESTION.finditer(section)]
    for qid in mentions:
        body_at = section.index(qid + ":") + len(qid) + 1
        _, marker, tail = section[body_at:].partition(qid + "_SCORE:")
        if not marker:
            continue
        stop = len(section) - len(tail) - len(marker)
        for other in set(mentions) - {qid}:
            at = section.find(other + ":", body_at)
            stop = min(stop, at) if at >= 0 else stop
        yield qid, section[body_at:stop], tail.split(" ", 1)[0].strip()


def items(reply):
    """``[(qid, text, score)]``, or None where the whole reply fails."""
    section = _between(reply, "QUALITY_ASSESSMENT")
    if section is None:
        found = UNMARKED_ITEM.findall(reply)
        if any(_float(shown) is None for _, _, shown in found):
            return None
    else:
        found = MARKED_ITEM.findall(section) or list(_by_position(section))
    return [
        (qid, text.strip().replace('"', ""), _float(shown))
        for qid, text, shown in found if _float(shown) is not None
    ]


def fields(reply):
    """``[(key, value)]`` in order, repeats included."""
    section = _between(reply, "DATA_EXTRACTION")
    if section is not None:
        found = [(k.strip(), v.strip()) for k, v in FIELD.findall(section)]
        if not found and section:
            found = [("TITLE", m.group(1).strip()) for m in [LOOSE_TITLE.search(section)] if m]
        return found
    _, _, below = reply.partition("Data Extraction")
    ends = [at for at in map(below.find, STOPS) if at >= 0]
    lines = below[: min(ends, default=len(below))].strip().split("\n")
    split = [line.partition(":") for line in lines]
    cleaned = [
        (k.strip().replace('"', "").replace("*", "").strip(), v.strip().replace('"', "").strip())
        for k, colon, v in split if colon
    ]
    return [(k, v) for k, v in cleaned if k]


def decision(reply, schema):
    """``(status, reason, excluding question)`` of a reply to a readable document."""
    if not reply:
        return "NO_RESPONSE", None, None
    found = items(reply)
    if found is None:
        return "PARSE_ERROR", None, None
    last = {qid: score for qid, _, score in found}
    for qid in schema.excluding:
        if last.get(qid) == 0:
            return "REJECTED", "EXCLUDED", qid
    total = sum(score for _, _, score in found)
    if total and total >= schema.cutoff:
        return "ANALYSED", None, None
    return "REJECTED", "CUTOFF", None
