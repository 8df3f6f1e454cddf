"""Text functions as column expressions. All are null in, null out unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title prefixes, removed in this order, each once.
TITLES = ["professor", "prof", "doctor", "dr", "mr", "mrs", "ms", "miss", "sir", "dame", "lord", "lady", "rev", "reverend"]

# Words without meaning for the comparison of facts.
STOP_WORDS = ["a", "an", "the", "is", "are", "was", "were", "has", "have", "had", "in", "of", "on", "at", "to", "for", "with", "and", "or", "but", "he", "she", "they", "their", "his", "her"]

# Superlatives that copy may not hold.
SUPERLATIVES = ["best", "leading", "top", "renowned", "world-class", "unparalleled", "premier", "foremost", "preeminent", "number one", "no. 1", "finest"]

# Phrases of a declaration that declares nothing.
EMPTY_DECLARATIONS = ["no interests to declare", "no financial interests", "nothing to declare", "no relevant interests", "has no interests to declare", "does not have any interests to declare", "no declarable interests", "does not hold a share", "does not have a financial", "does not hold a financial interest", "no share or financial interest"]

# Leftovers of page rendering.
ARTEFACTS = ["Browser doesn't support frames", "Browser does not support frames"]

# Headings by their whole text, their start, or a part of it.
HEADINGS = {"about": "ABOUT", "qualifications": "QUALIFICATIONS", "specialties": "SPECIALTIES", "consultation times": "CONSULTATION_TIMES", "related experience": "RELATED_EXPERIENCE", "declaration": "DECLARATION", "special interests": "SPECIAL_INTERESTS", "other interests": "OTHER_INTERESTS", "personal interests": "PERSONAL_INTERESTS", "languages spoken": "LANGUAGES", "research": "RESEARCH", "memberships": "MEMBERSHIPS", "other posts held": "OTHER_POSTS", "professional roles": "PROFESSIONAL_ROLES", "in the news": "IN_THE_NEWS"}
HEADING_STARTS = {"practising since": "PRACTISING_SINCE", "insurers": "INSURERS", "locations": "LOCATIONS"}
TREATMENT_HEADINGS = ["treatments and tests offered", "treatments, tests and scans", "specialises in the following treatments", "specialises the following treatments", "performs the following treatments", "specialises in the following cosmetic treatments at"]
CALLS_TO_ACTION = ["book online", "ask a question", "enquire now"]


def any_of(conditions) -> Column:
    return reduce(Column.__or__, conditions)


def empty_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def spaces(text: Column) -> Column:
    """Runs of any white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise(text: Column) -> Column:
    """Without tags and with single spaces; null if nothing is left."""
    return empty_to_null(spaces(F.regexp_replace(text, "<[^>]*>", "")))


def delimited(text: Column) -> Column:
    """The non-empty parts between semicolons and commas."""
    return F.filter(F.transform(F.split(text, "[;,]"), normalise), lambda x: x.isNotNull())


def section_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def registration_number(text: Column) -> Column:
    """Digits without leading zeros; null if there is none, '0' if all are zero."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(digits != "", F.coalesce(empty_to_null(F.regexp_replace(digits, "^0+", "")), F.lit("0")))


def registration_label(number: Column) -> Column:
    return F.when(F.upper(number).startswith("HCPC"), F.concat(F.lit("HCPC-"), registration_number(number))).otherwise(number)


def name_key(name: Column) -> Column:
    """A person's name for matching: lower case, without titles and marks."""
    out = F.regexp_replace(spaces(F.lower(name)), "[_-]+", " ")
    for title in TITLES:
        out = F.regexp_replace(out, rf"^{title}\.?\s+", "")
    return spaces(F.regexp_replace(out, r"[^a-z\s]", ""))


def core_signature(key: Column) -> Column:
    """First and last word of a name key; null with fewer than two words."""
    words = F.split(key, " ")
    return F.when(F.size(words) >= 2, F.concat_ws(":", words[0], F.element_at(words, -1)))


def loose_signature(key: Column) -> Column:
    """First letter and last word of a name key; null with fewer than two words."""
    words = F.split(key, " ")
    return F.when(F.size(words) >= 2, F.concat_ws(":", F.substring(words[0], 1, 1), F.element_at(words, -1)))


def fact_words(fact: Column) -> Column:
    """Distinct words of more than two letters that are no stop words."""
    words = F.split(spaces(F.regexp_replace(F.lower(fact), r"[^\w\s]", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def first_year(text: Column) -> Column:
    """The first four digits in a row, if they are a year from 1950 to 2030."""
    digits = F.regexp_extract(text, r"(\d{4})", 1)
    year = F.when(digits != "", digits.cast("int"))
    return F.when(year.between(1950, 2030), year)


def whole_year(text: Column) -> Column:
    """The first year of 1900 to 2099 that stands by itself, no part of a longer word."""
    return empty_to_null(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)).cast("int")


def heading_category(text: Column, tag: Column) -> Column:
    """A section heading's category, calls to action first; null if unknown."""
    low = F.lower(F.trim(text))
    out = F.when(any_of(low.contains(p) for p in CALLS_TO_ACTION), "CTA_EXCLUDE")
    out = out.when(low == "overview", F.when(F.lower(tag).isin("h2", "h3", "h4"), "OVERVIEW"))
    for name, category in HEADINGS.items():
        out = out.when(low == name, category)
    for start, category in HEADING_STARTS.items():
        out = out.when(low.startswith(start), category)
    return out.when(any_of(low.contains(p) for p in TREATMENT_HEADINGS), "TREATMENTS")


def bio_depth(text: Column) -> Column:
    """By trimmed length: missing, thin (to 100), adequate (to 300), substantive. Null is missing."""
    n = F.coalesce(F.length(F.trim(text)), F.lit(0))
    return F.when(n == 0, "missing").when(n <= 100, "thin").when(n <= 300, "adequate").otherwise("substantive")


def declares_something(text: Column) -> Column:
    low = F.lower(text)
    return F.when(any_of(low.contains(p) for p in EMPTY_DECLARATIONS), False).otherwise(F.length(F.trim(text)) > 10)


def without_artefacts(text: Column) -> Column:
    for phrase in ARTEFACTS:
        text = F.replace(text, F.lit(phrase), F.lit(""))
    return empty_to_null(F.trim(text))


def superlatives(text: Column) -> Column:
    """The blocked terms that a text holds as whole words, in list order."""
    hits = [F.when(F.lower(text).rlike("(?<![a-z0-9_])" + t.replace(".", r"\.") + "(?![a-z0-9_])"), F.lit(t)) for t in SUPERLATIVES]
    return F.array_compact(F.array(*hits))


# How national numbers are written, tried in this order at each place of a text.
PHONE_SHAPES = [r"0[1-3]\d{1,3}\s*\d{3,4}\s*\d{3,4}", r"07\d{3}\s*\d{3}\s*\d{3}", r"0300\s*\d{3}\s*\d{4}", r"0[1-3]\d{8,9}", r"07\d{9}", r"0300\d{7}"]
NO_BREAK_SPACE = "\u00a0"


def phone(text: Column) -> Column:
    """A national number without spaces, hyphens and brackets, or null if it is none."""
    bare = F.regexp_replace(F.translate(text, NO_BREAK_SPACE, " "), r"[\s\-()]+", "")
    return F.when(bare.rlike(r"^0[1-37]\d{8,9}$"), bare)


def phones(text: Column) -> Column:
    """Distinct numbers in a text, in order. Numbers that stand side by side are told apart by the groups in which each kind is written."""
    found = F.regexp_extract_all(F.translate(text, NO_BREAK_SPACE, " "), F.lit(f"({'|'.join(PHONE_SHAPES)})"), 1)
    return F.array_distinct(F.filter(F.transform(found, phone), lambda x: x.isNotNull()))


def first_mobile(numbers: Column) -> Column:
    return F.get(F.filter(numbers, lambda x: x.startswith("07")), F.lit(0))


def first_landline(numbers: Column) -> Column:
    return F.get(F.filter(numbers, lambda x: ~x.startswith("07")), F.lit(0))


def emails(text: Column) -> Column:
    """Distinct addresses in a text, in order; a sentence's stop after one is no part of it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_+-][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+)"), 1))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def host_blocked(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    h = host(url)
    return any_of((h == d) | h.endswith("." + d) for d in domains)


def snippet(html: Column, length: int = 3000) -> Column:
    """Visible text of a page, scripts and styles apart, to a length."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]+>", " ")
    return F.substring(spaces(bare), 1, length)


def csv_field(value: Column) -> Column:
    """Quoted only if it holds a comma, a quote or a line feed; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def duration(start: Column, end: Column) -> Column:
    """'3m 20s' between two timestamps."""
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.format_string("%dm %ds", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"))


# The patterns of age limits, of words that asterisks break, and of a registration number.
ADULTS_ONLY = r"(?i)only\s+sees?\s+adults"
AGE_RANGE = r"(?i)(?:from\s+(?:the\s+)?)?ages?\s+(?:of\s+)?(\d{1,3})\s*(?:to|-)\s*(\d{1,3})"
AGE_LEAST = r"(?i)(?:ages?\s+(?:of\s+)?(?:over|above)|(?:over|above)\s+(?:the\s+)?age\s+(?:of\s+)?)(\d{1,3})"
BROKEN_WORD = r"\w\*{2,}\w|\*{2,}\w+\*{2,}"
REGISTRATION = r"(?i)GMC\s*number:\s*([A-Za-z0-9-]+)"


def _age(text: Column, least: Column, most: Column) -> Column:
    return F.struct(text.alias("text"), least.cast("int").alias("least"), most.cast("int").alias("most"))


def age_limit(text: Column) -> Column:
    """(text, least, most) from a short text: a range up to 120, else a least age; null if it states none."""
    a, b, c = (empty_to_null(F.regexp_extract(text, p, i)).cast("int") for p, i in ((AGE_RANGE, 1), (AGE_RANGE, 2), (AGE_LEAST, 1)))
    ranged = F.when((a <= b) & (b <= 120), _age(F.regexp_extract(text, AGE_RANGE, 0), a, b))
    return ranged.when(c <= 120, _age(F.regexp_extract(text, AGE_LEAST, 0), c, F.lit(None)))


def age_restriction(body: Column, candidates: Column) -> Column:
    """A page's age limit: adults only if its body says so anywhere, else the first that one of the candidates, short texts in order, states."""
    adults = empty_to_null(F.regexp_extract(body, ADULTS_ONLY, 0))
    found = F.get(F.filter(F.transform(candidates, age_limit), lambda x: x.isNotNull()), F.lit(0))
    return F.when(adults.isNotNull(), _age(adults, F.lit(18), F.lit(None))).otherwise(found)


def broken_words(text: Column) -> Column:
    """Whether asterisks break a word or stand around one."""
    return text.rlike(BROKEN_WORD)


def registration_code(text: Column) -> Column:
    """The registration number that a page states, as it stands there."""
    return empty_to_null(F.regexp_extract(text, REGISTRATION, 1))


def booking_code(number: Column) -> Column:
    """A registration number if it is all digits."""
    return F.when(number.rlike("^[0-9]+$"), number)


def rating(text: Column) -> Column:
    """The inspectors' rating, with or without a colon before it."""
    # Fixed value: the pattern.
    return empty_to_null(F.regexp_extract(text, r"(?i)CQC\s*(?:Overall\s+)?rating\s*:?\s*(Outstanding|Good|Requires improvement|Inadequate)", 1))


def labelled_parts(**parts: Column) -> Column:
    """'Label: text' parts, nulls left out, a blank line between."""
    return F.concat_ws("\n\n", *[F.when(v.isNotNull() & (v != ""), F.concat(F.lit(k.replace("_", " ") + ": "), v)) for k, v in parts.items()])


def without_fences(text: Column) -> Column:
    """Without the code fences around an answer."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^```[a-z]*\s*$", ""), r"^\s+|\s+$", "")


def plain(text: Column) -> Column:
    """Markdown marks removed for display."""
    for pattern, to in ((r"\*\*(.+?)\*\*", "$1"), (r"(?m)^#+\s*", ""), (r"(?m)^[-*]\s+", ""), (r"\[(.+?)\]\(.+?\)", "$1"), ("`", "")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)
