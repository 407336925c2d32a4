"""Values that results depend on: markers, patterns, wording and limits.

Everything in this file is a fixed value. Changing one changes what is parsed
or written, so they are kept together and stated plainly.
"""

# --- Fixed values: characters that count as white space when text is stripped,
# as first and last code point of each run.
_SPACE_RUNS = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
SPACES = "".join(chr(c) for first, last in _SPACE_RUNS for c in range(first, last + 1))
# The same set for use inside a Java character class.
SPACE_RANGE = "".join(rf"\x{{{first:x}}}-\x{{{last:x}}}" for first, last in _SPACE_RUNS)
SPACE = f"[{SPACE_RANGE}]"

# --- Fixed values: section markers of a well-formed reply.
QA_START = "==QUALITY_ASSESSMENT_START=="
QA_END = "==QUALITY_ASSESSMENT_END=="
DE_START = "==DATA_EXTRACTION_START=="
DE_END = "==DATA_EXTRACTION_END=="

# --- Fixed values: question ids and score markers.
QUESTION_ID = r"QE\p{Nd}+"
SCORE_SUFFIX = "_SCORE"
TOTAL_SCORE = "TOTAL_SCORE"
TITLE = "TITLE"
TITLE_KEYS = ("TITLE", "Title", "title")

# --- Fixed values: fields of a marked data-extraction section. A value is read in
# runs, of capitals and spaces or of anything else, and ends in the first run that
# leads to a key; so each run is looked at once, whatever its length. A field opens
# where the last one ended or with a run, white space before its key included.
FIELD_KEY = rf"[A-Z][A-Z{SPACE_RANGE}]++:"
FIELD = (
    rf"(?s)(?:\G|(?<![A-Z{SPACE_RANGE}])){SPACE}*+{FIELD_KEY}{SPACE}*+"
    rf"(?:[^A-Z{SPACE_RANGE}]++|(?![A-Z]*+{SPACE}++{FIELD_KEY})[A-Z{SPACE_RANGE}]++)*+[A-Z]*+"
)
# Letters that equal an ASCII letter when case is ignored, the dotted and dotless
# i, the long s and the Kelvin sign included.
ANY_CASE_LETTER = r"[A-Za-z\x{130}\x{131}\x{17f}\x{212a}]"
LOOSE_TITLE = (
    rf"(?s)[Tt][Ii\x{{130}}\x{{131}}][Tt][Ll][Ee]{SPACE}*+:(.*?)"
    rf"(?={SPACE}{ANY_CASE_LETTER}{{2,}}|\z)"
)

# --- Fixed values: heading and end of an unmarked data-extraction section.
DE_HEADING = "Data Extraction"
DE_STOPS = r"Minimum acceptance score|SECTION 3|Cutoff Score|\n\n\n"

# --- Fixed values: number spellings a score may take.
NUMBER = (
    r"^[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)"
    r"(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?\z"
)
INFINITY = r"(?i)^[+-]?inf(?:inity)?\z"
NOT_A_NUMBER = r"(?i)^[+-]?nan\z"

# --- Fixed values: limits and notices.
PREVIEW_CHARS = 5000
PREVIEW_NOTICE = "\n\n... [content truncated for debug file only] ..."
TRUNCATION_NOTICE = "... [Content truncated due to length]"
NO_RESPONSE_NOTICE = "*** NO RESPONSE RECEIVED ***"
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
LOG_RULE = "=" * 80
LOG_HEADING = "=== LLM Response Log - Started at %s ===\n\nUsing LLM backend at %s (model: %s)\n"

# --- Fixed values: request defaults and retry policy.
SYSTEM_MESSAGE = "Be precise in your answers and follow the given instructions."
TEMPERATURE = 0.1
MAX_TOKENS = 1024
MAX_RETRIES = 3
RETRY_BACKOFF = 2.0
RETRYABLE_STATUSES = (500, 502, 503, 504)
RETRYABLE_ERRORS = ("connection", "timeout")
DOCUMENTS_PER_CONVERSATION = 10

# --- Fixed values: wording of the review prompt.
PROMPT_OPENING = (
    "Hello, I need you to analyze the PDF document I've uploaded. "
    "Please follow these instructions precisely:\n\n"
    "===== PART 1: QUALITY ASSESSMENT =====\n"
)
PROMPT_FIELDS_HEADING = "\n===== PART 2: DATA EXTRACTION =====\n"
PROMPT_CUTOFF = "\nMinimum acceptance score: "
PROMPT_CLOSING = """

===== OUTPUT FORMAT INSTRUCTIONS =====
For Quality Assessment, follow this exact format with no deviations:

==QUALITY_ASSESSMENT_START==
QE1: [Your brief description here]
QE1_SCORE: [score]

QE2: [Your brief description here]
QE2_SCORE: [score]
==QUALITY_ASSESSMENT_END==

For Data Extraction, follow this exact format with no deviations:

==DATA_EXTRACTION_START==
AUTHOR: [author names]
YEAR: [publication year]
TITLE: [paper title]
==DATA_EXTRACTION_END==

IMPORTANT INSTRUCTIONS:
1. Use EXACTLY the section markers shown above (==SECTION_START== and ==SECTION_END==)
2. For quality assessment items, use the exact format 'QE1: [text]' followed by a line break and 'QE1_SCORE: [number]'
3. For data extraction fields, use the exact keys I've listed, in ALL CAPS followed by a colon
4. If information is not available, write 'Not Specified (N/S)'
5. Do not add any additional formatting, bullets, or markdown
6. Each item should be on its own line
7. You should respect the line breaks here and replicate them if they exist
"""
CONTENT_HEADING = "PDF CONTENT:\n"
TASK_HEADING = "\n\nTASK:\n"

# --- Fixed values: document states and reject reasons.
NO_TEXT = "NO_TEXT"
NO_RESPONSE = "NO_RESPONSE"
PARSE_ERROR = "PARSE_ERROR"
REJECTED = "REJECTED"
ANALYSED = "ANALYSED"
DECIDED = (ANALYSED, REJECTED)
EXCLUDED = "EXCLUDED"
CUTOFF = "CUTOFF"
