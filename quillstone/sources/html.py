"""HTML pages to profile fields: one small parser gives a page's outline, and column expressions do the rest."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from quillstone.functions import arrays, text

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Elements that stand within a line: the body's text has a line break around every other one, so words of neighbouring blocks do not grow together.
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "small", "span", "strike", "strong", "sub", "sup", "tt", "u", "var", "wbr"}
_CONSENT = {"ccc", "cookie-consent", "onetrust-consent-sdk"}
_LINKS = "array<struct<href:string,text:string,tel:string>>"
_SHORT = re.compile(r"\bage[sd]?\b", re.I)
# The classes of what a page says beside its booking, in order of preference; "booking" stands for any class that holds the word.
_CAVEATS = (("", "booking-caveat"), ("", "booking__caveat"), ("p", "booking"), ("caveat", "booking"))
# Classes and ids under which rivals' pages show a name, a biography or sites.
RIVAL_MARKS = {
    "name": ["consultant-name", "specialist-name", "profile-name", "consultant-profile__name"],
    "about_text": ["consultant-about", "consultant-bio", "consultant-biography", "consultant-profile__about", "about-text"],
    "hospitals": ["hospital-list", "consultant-hospitals", "location-list", "available-hospitals"],
}
_LISTS_OF, _MARKS = set(RIVAL_MARKS["hospitals"]), {*RIVAL_MARKS["name"], *RIVAL_MARKS["about_text"]}
OUTLINE = (
    f"title string, h1s array<struct<text:string,named:boolean,consent:boolean>>, metas array<struct<name:string,content:string>>, links {_LINKS}, frames array<string>,"
    " photo string, images array<struct<src:string,alt:string>>, marks array<string>, telephones array<string>, booking boolean, sites array<string>,"
    " shorts array<string>, caveats array<string>, data array<struct<name:string,value:string>>, parts array<struct<mark:string,text:string>>,"
    f" sections array<struct<tag:string,heading:string,blocks:array<string>,items:array<string>,subheads:array<string>,links:{_LINKS}>>, body string"
)


class Outline(HTMLParser):
    """A heading's section runs to the next heading of its level or above, or to the end of the element that holds the heading.

    Character references are decoded as browsers do, or only those of the given names, written in full; all others then stay as written.
    """

    def __init__(self, references: tuple[str, ...] | None = None):
        self.others = None if references is None else re.compile(rf"&(?!(?:{'|'.join(map(re.escape, references))});)")
        super().__init__(convert_charrefs=True)
        self.stack, self.text, self.body, self.open, self.skip = [], [], [], [], 0
        self.out = {"title": None, "h1s": [], "metas": [], "links": [], "frames": [], "photo": None, "images": [], "marks": [], "telephones": [], "booking": False, "sites": [], "shorts": [], "caveats": [""] * len(_CAVEATS), "data": [], "parts": [], "sections": []}
        self.shorts: list[tuple[int, str]] = []
        self.sections: list[tuple[int, int, dict]] = []  # level, depth, section

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag not in _INLINE:
            self.body.append("\n")
        marks = set(a.get("class", "").split()) | {a.get("id", "")}
        self.out["data"] += [{"name": k, "value": v} for k, v in a.items() if k.startswith("data-")]
        if tag in ("p", "div", "li"):  # what holds a block is no short text
            for o in self.open:
                o["plain"] = False
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        if any("booking" in m for m in marks):
            self.out["booking"] = True
        if tag == "meta":
            self.out["metas"].append({"name": a.get("name") or a.get("property"), "content": a.get("content")})
        elif tag == "iframe":
            self.out["frames"].append(a.get("src"))
        elif tag == "img":
            self.out["images"].append({"src": a.get("src"), "alt": a.get("alt")})
            if self.out["photo"] is None and any("consultant__image" in m for _, m in self.stack):
                self.out["photo"] = a.get("src")
        self.out["marks"] += [m for m in marks if "assured" in m]
        if tag in _VOID:
            if tag == "br":
                self.text.append("\n")
            return
        level = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else 0
        depth = len(self.stack)
        if level:
            self.sections = [s for s in self.sections if s[0] < level]
        self.stack.append((tag, marks))
        self.open.append({"tag": tag, "at": len(self.text), "a": a, "marks": marks, "level": level, "depth": depth, "plain": tag in ("p", "li", "span", "div"), "from": self.getpos()})

    def handle_endtag(self, tag):
        if tag not in _INLINE:
            self.body.append("\n")
        if tag in ("script", "style", "noscript") and self.skip:
            self.skip -= 1
        if tag in _VOID or all(o["tag"] != tag for o in self.open):
            return
        while True:
            o = self.open.pop()
            self.stack.pop()
            self._closed(o)
            if o["tag"] == tag:
                return

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            self.body.append(data)

    def _closed(self, o):
        words = "".join(self.text[o["at"] :]).strip()
        tag, out = o["tag"], self.out
        self.sections = [s for s in self.sections if s[1] <= o["depth"]]
        for _, depth, section in self.sections:
            if tag == "li" and words:
                section["items"].append(words)
            if tag == "a" and words and o["a"].get("href") and o["depth"] > depth:  # within the heading's siblings
                section["links"].append({"href": o["a"]["href"], "text": words, "tel": o["a"].get("data-tel-href")})
            if o["level"] and words:
                section["subheads"].append(words)
            if depth == o["depth"] and words:
                section["blocks"].append(words)
        if o["plain"] and 0 < len(words) < 200 and _SHORT.search(words):
            self.shorts.append((o["from"], words))
        for i, (what, where) in enumerate(_CAVEATS):
            inside = any(where in m for _, ms in self.stack for m in ms)
            if where in o["marks"] if not what else inside and (tag == what or what in o["marks"]):
                out["caveats"][i] += words
        out["parts"] += [{"mark": m, "text": words} for m in o["marks"] & _MARKS if words]
        if tag == "li" and words:
            out["parts"] += [{"mark": m, "text": words} for _, ms in self.stack for m in ms & _LISTS_OF]
        if tag == "title":
            out["title"] = words
        elif tag == "a":
            out["links"].append({"href": o["a"].get("href"), "text": words, "tel": o["a"].get("data-tel-href")})
        elif tag == "h1":
            out["h1s"].append({"text": words, "named": o["a"].get("itemprop") == "name", "consent": any(m & _CONSENT for _, m in self.stack)})
        if o["a"].get("itemprop") == "telephone":
            out["telephones"].append(words)
        if o["marks"] & {"consultant__hospital", "hospital-name"}:
            out["sites"].append(words)
        if 2 <= o["level"] <= 6:
            section = {"tag": tag, "heading": words, "blocks": [], "items": [], "subheads": [], "links": []}
            out["sections"].append(section)
            self.sections.append((o["level"], o["depth"], section))

    def result(self, html: str) -> dict:
        self.feed(html if self.others is None else self.others.sub("&amp;", html))
        self.close()
        while self.open:
            self._closed((self.open.pop(), self.stack.pop())[0])
        return self.out | {"shorts": [t for _, t in sorted(self.shorts, key=lambda x: x[0])], "body": "".join(self.body)}


def slices(bytes_each: list[int], most_rows: int, most_bytes: int) -> list[tuple[int, int]]:
    """Runs of rows, from and to, of at most so many rows and bytes; a larger row is one alone."""
    cut, held = [0], 0
    for i, n in enumerate(bytes_each):
        if i > cut[-1] and (i - cut[-1] >= most_rows or held + n > most_bytes):
            cut.append(i)
            held = 0
        held += n
    return list(zip(cut, [*cut[1:], len(bytes_each)])) if bytes_each else []


def outlined(pages: DataFrame, html_col: str = "html", references: tuple[str, ...] | None = None, most_rows: int = 64, most_bytes: int = 1 << 20) -> DataFrame:
    """`pages` with each page's outline as a struct `o` (OUTLINE). Outlines, many times their pages' size as Python objects, are made and passed on for at most so many pages and bytes at a time."""
    outline = StructType.fromDDL(OUTLINE)
    schema, kind = StructType([*pages.schema.fields]).add("o", outline), to_arrow_type(outline)

    def run(batches):
        for batch in batches:
            html = batch.column(html_col)
            for i, j in slices(pc.fill_null(pc.binary_length(html), 0).to_pylist(), most_rows, most_bytes):
                made = pa.array([Outline(references).result(x.as_py() or "") for x in html.slice(i, j - i)], kind)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, made], [*batch.schema.names, "o"])

    return pages.mapInArrow(run, schema)


def _of(category: str) -> Column:
    return F.filter("classified", lambda s: s.category == category)


def _first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def _clean(items: Column) -> Column:
    bare = F.transform(items, lambda x: F.trim(F.regexp_replace(x, r",\s*$", "")))
    return F.filter(bare, lambda x: x != "")


def _list(category: str) -> Column:
    """All list items of a category's sections, or their blocks' lines without a leading label."""
    lines = lambda s: F.flatten(F.transform(s.blocks, lambda b: F.split(F.regexp_replace(b, r"(?i)^(sub-specialties|specialties|treatments):\s*", ""), "\n")))
    return _clean(F.flatten(F.transform(_of(category), lambda s: F.when(F.size(s["items"]) > 0, s["items"]).otherwise(lines(s)))))


def _text(category: str) -> Column:
    return text.empty_to_null(F.array_join(_first(_of(category)).blocks, "\n"))


def parse(pages: DataFrame, html_col: str = "html", own_domains: tuple[str, ...] = (), network: str = "", references: tuple[str, ...] | None = None) -> DataFrame:
    """`pages` without its html, with the profile fields that a page shows. A null page has nulls and empty arrays.

    Links to `own_domains` are no external website. `network` is the name of the network whose sites the pages are about: a site is in it unless it says otherwise.
    `references`: the names of the character references to decode, if not all.
    """
    p = outlined(pages, html_col, references)
    classified = F.transform("o.sections", lambda s: F.struct(text.heading_category(s.heading, s.tag).alias("category"), s.heading.alias("heading"), s.blocks.alias("blocks"), s["items"].alias("items"), s.subheads.alias("subheads"), s.links.alias("links")))
    p = p.withColumn("classified", classified)
    h1 = F.coalesce(
        _first(F.filter("o.h1s", lambda h: h.named & (h.text != ""))).text,
        text.empty_to_null(F.trim(_first(F.filter("o.metas", lambda m: m["name"] == "fullname")).content)),
        _first(F.filter("o.h1s", lambda h: ~h.consent & (h.text != ""))).text,
    )
    title = F.coalesce(*[F.when(F.lower(h1).rlike(rf"^{t.lower()}\b"), F.lit("Professor" if t == "Prof" else t)) for t in ("Professor", "Prof", "Dr", "Mr", "Mrs", "Ms", "Miss", "Sir", "Dame")])
    numbers = F.filter(F.transform("o.telephones", text.phone), lambda x: x.isNotNull())
    tel = F.filter(F.transform(F.filter("o.links", lambda a: a.href.startswith("tel:")), lambda a: text.phone(F.regexp_replace(a.href, "^tel:", ""))), lambda x: x.isNotNull())
    numbers = F.when(F.size(numbers) > 0, F.array_distinct(numbers)).when(F.size(tel) > 0, F.array_distinct(tel)).otherwise(text.phones(F.col("o.body")))
    mail = _first(F.filter("o.links", lambda a: a.href.startswith("mailto:"))).href
    # wrapped links and these platforms are nobody's own site
    own = lambda a: a.href.startswith("http") & ~text.any_of([F.coalesce(text.host(a.href), F.lit("")).contains(d) for d in ("facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "safelinks.protection", *own_domains)])
    year = F.coalesce(
        text.first_year(_first(_of("PRACTISING_SINCE")).heading),
        text.first_year(F.array_join(_first(_of("PRACTISING_SINCE")).blocks, " ")),
        text.first_year(_first(F.filter(F.flatten(F.transform(F.filter("classified", lambda s: s.category.isin("QUALIFICATIONS", "RELATED_EXPERIENCE")), lambda s: s.blocks)), lambda b: F.lower(b).contains("practising since")))),
    )
    place = _first(_of("LOCATIONS"))
    site = F.coalesce(text.empty_to_null(_first(place.subheads)), text.empty_to_null(_first(F.col("o.sites"))))
    code = _first(F.filter(F.transform(place.links, lambda a: F.regexp_extract(a.href, r"hospitals/([^/?#]+)", 1)), lambda x: x != ""))
    about, declaration = text.without_artefacts(_text("ABOUT")), F.array_join(_first(_of("DECLARATION")).blocks, " ")
    labelled = F.flatten(F.transform(F.filter(_first(_of("SPECIALTIES")).blocks, lambda b: F.lower(b).startswith("sub-specialties:")), lambda b: F.split(F.regexp_replace(b, r"(?i)^sub-specialties:\s*", ""), r",\s*")))
    frame = F.exists("o.frames", lambda f: f.contains("book"))
    age = text.age_restriction(F.col("o.body"), F.col("o.shorts"))
    registration = text.registration_code(F.col("o.body"))
    caveat = _first(F.filter(F.transform("o.caveats", F.trim), lambda x: F.lower(x).contains("booking")))
    caveat = F.coalesce(caveat, text.empty_to_null(F.trim(F.regexp_extract(F.col(html_col), r"(?i)Online booking is[^<]*(?:only|initial)[^<]*", 0))))
    outside = rf"(?i)\b(?:non-?{re.escape(network.split()[0])}|independent)\b" if network else r"(?i)\bindependent\b"
    at_partner = site.rlike(rf"(?i){r'\s+'.join(map(re.escape, network.split()))}\s+at\s+") if network else F.lit(False)
    interests, none = _list("SPECIAL_INTERESTS"), F.array().cast("array<string>")
    treatments = F.when(F.size(_list("TREATMENTS")) > 0, _list("TREATMENTS")).otherwise(interests)
    declared = text.declares_something(text.empty_to_null(declaration))
    fields = {
        "name": text.spaces(h1),
        "title": title,
        "registration_number": registration,
        "booking_code": text.booking_code(registration),
        "has_photo": F.coalesce(F.col("o.photo").rlike("^(http|/)"), F.lit(False)),
        "booking_state": F.when(F.coalesce(frame, F.lit(False)) | F.col("o.booking"), "bookable_no_slots").otherwise("not_bookable"),
        "booking_caveat": caveat,
        "about_text": about,
        "overview_text": text.without_artefacts(_text("OVERVIEW")),
        "related_experience_text": text.without_artefacts(_text("RELATED_EXPERIENCE")),
        "bio_depth": text.bio_depth(about),
        "specialty_primary": _list("SPECIALTIES"),
        "specialty_sub": F.coalesce(_clean(F.concat(_first(_of("SPECIALTIES")).subheads, labelled)), F.array().cast("array<string>")),
        "treatments": F.coalesce(arrays.distinct_ci(treatments), none),
        "treatments_excluded": none,
        "qualifications": _text("QUALIFICATIONS"),
        "memberships": F.coalesce(arrays.distinct_ci(_list("MEMBERSHIPS")), none),
        "clinical_interests": F.coalesce(arrays.distinct_ci(F.concat(interests, _list("OTHER_INTERESTS"))), none),
        "personal_interests": _text("PERSONAL_INTERESTS"),
        "professional_roles": _text("PROFESSIONAL_ROLES"),
        "insurers": arrays.distinct_ci(_list("INSURERS")),
        "insurer_count": F.size(_list("INSURERS")),
        "consultation_times": _list("CONSULTATION_TIMES"),
        "languages": _list("LANGUAGES"),
        "practising_since": year,
        "declaration": F.when(F.size(_first(_of("DECLARATION")).blocks) > 0, _first(_of("DECLARATION")).blocks),
        "declaration_substantive": declared,
        "news": F.transform(_first(_of("IN_THE_NEWS")).links, lambda a: F.struct(a.text.alias("title"), a.href.alias("url"))),
        "phone": text.first_landline(numbers),
        "mobile": text.first_mobile(numbers),
        "email": text.empty_to_null(F.trim(F.try_url_decode(F.regexp_replace(mail, r"^mailto:|\?.*$", "")))),
        "website": _first(F.filter("o.links", own)).href,
        "rating": text.rating(F.col("o.body")),
        "site": site,
        "site_code": code,
        "in_network": ~F.coalesce(site.rlike(outside), F.lit(False)),
        "at_partner": F.coalesce(at_partner, F.lit(False)),
        "age_text": age["text"],
        "age_least": age.least,
        "age_most": age.most,
        "cms_corruption": F.coalesce(text.broken_words(F.col("o.body")), F.lit(False)),
        "sections": F.transform(F.filter("classified", lambda s: s.category.isNotNull()), lambda s: s.category),
    }
    out = p.select(*[c for c in pages.columns if c != html_col], *[v.alias(k) for k, v in fields.items()])
    sure = confidence()
    return out.withColumns({"confidence": sure, "low_confidence": F.map_keys(F.map_filter(sure, lambda k, v: v == "low"))})


# The fields whose reading is graded, with the grade of one that was not found.
GRADES = {
    "name": "low", "title": "medium", "registration_number": "low", "has_photo": "high", "specialty_primary": "medium", "specialty_sub": "medium", "treatments": "medium", "insurers": "medium", "qualifications": "medium",
    "practising_since": "medium", "memberships": "medium", "clinical_interests": "medium", "personal_interests": "medium", "languages": "medium", "consultation_times": "medium", "declaration": "medium", "news": "medium",
    "professional_roles": "medium", "site": "medium", "booking_state": "high", "phone": "medium", "email": "medium", "age_text": "medium", "rating": "medium", "website": "medium",
}
_LISTS = {"specialty_primary", "specialty_sub", "treatments", "insurers", "memberships", "clinical_interests", "languages", "consultation_times", "news"}


def confidence() -> Column:
    """map<field, grade> of a parsed row: high where the field was found. Treatments taken from special interests count as not found."""
    found = {k: F.col(k).isNotNull() & (F.size(k) > 0) if k in _LISTS else F.coalesce(F.col(k).cast("string"), F.lit("")) != "" for k in GRADES}
    found["treatments"] = F.array_contains("sections", "TREATMENTS") & (F.size("treatments") > 0)
    return F.create_map(*[x for k, other in GRADES.items() for x in (F.lit(k), F.when(F.coalesce(found[k], F.lit(False)), "high").otherwise(other))])


def page_flags() -> dict[str, Column]:
    """Conditions of the flags that come from reading a page, for scoring.flags(extra)."""
    return {
        "CONTENT_CMS_CORRUPTION": F.col("cms_corruption"),
        "PROFILE_SUBSTANTIVE_DECLARATION": F.coalesce(F.col("declaration_substantive"), F.lit(False)),
        "PROFILE_OUTSIDE_NETWORK": ~F.col("in_network"),
        "PROFILE_AGE_RESTRICTION": F.col("age_text").isNotNull(),
        "QA_LOW_CONFIDENCE": F.size("low_confidence") > 0,
    }


def anomalous(unmapped: Column, about: Column, treatments: Column, phones: Column) -> Column:
    """Whether a rival's page was read badly: a section that maps to no field, no biography, no treatment or no telephone."""
    return (arrays.length(unmapped) > 0) | about.isNull() | arrays.missing(treatments) | arrays.missing(phones)


def sections_by_key(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(…, sections map<key, struct<heading, values>>) as a rival's pages are read: each section under its normalised heading, equal headings merged."""
    return _with_sections(outlined(pages, html_col)).select(*[c for c in pages.columns if c != html_col], "sections")


def _with_sections(p: DataFrame) -> DataFrame:
    """Outlined pages with their `sections`."""
    rows = F.transform("o.sections", lambda s: F.struct(text.section_key(s.heading).alias("key"), s.heading.alias("heading"), F.when(F.size(s["items"]) > 0, s["items"]).otherwise(s.blocks).alias("values")))
    keys = F.array_distinct(F.transform(rows, lambda r: r.key))
    merged = F.transform(keys, lambda k: F.struct(k, F.struct(_first(F.filter(rows, lambda r: r.key == k)).heading.alias("heading"), F.array_distinct(F.filter(F.transform(F.flatten(F.transform(F.filter(rows, lambda r: r.key == k), lambda r: r["values"])), text.normalise), lambda v: v.isNotNull())).alias("values"))))
    return p.withColumn("sections", F.map_from_entries(merged))


def section_values(sections: Column, *headings: str) -> Column:
    """The values of the first named section that has any."""
    found = [F.try_element_at(sections, text.section_key(F.lit(h)))["values"] for h in headings]
    return F.coalesce(*[F.when(F.size(v) > 0, v) for v in found])


def section_list(sections: Column, *headings: str) -> Column:
    """section_values cut at semicolons and commas."""
    return F.array_distinct(F.flatten(F.transform(section_values(sections, *headings), text.delimited)))


# The headings under which rivals' pages list a field.
RIVAL_HEADINGS = {
    "about_text": ["About", "About me", "Biography", "Profile", "Overview"],
    "specialty_primary": ["Specialties", "Speciality", "Specialty", "Main specialties", "Primary specialty"],
    "specialty_sub": ["Sub-specialties", "Sub specialties", "Sub-specialities", "Other specialties"],
    "treatments": ["Treatments", "Procedures", "Treatments and procedures", "Treatments & procedures", "Specialises in"],
    "qualifications": ["Qualifications", "Qualifications and credentials", "Education and qualifications", "Credentials"],
    "memberships": ["Memberships", "Affiliations / memberships", "Professional memberships", "Memberships and associations", "Professional bodies", "Professional bodies (positions held - last 3 yrs)"],
    "clinical_interests": ["Clinical interests", "Special interests", "Areas of interest", "Interests"],
    "languages": ["Languages", "Languages spoken"],
    "hospitals": ["Hospitals", "Hospital affiliations", "Practises at", "Available at", "Locations", "Where I practise"],
    "registration": ["GMC registration", "Registration"],
    "training": ["Additional training"],
}


def parse_rival(pages: DataFrame, html_col: str = "html", badge: str = "accredited") -> DataFrame:
    """`pages` without its html, with the fields that a rival's profile page shows; `badge`: a word of its badges' image texts."""
    kept = [c for c in pages.columns if c != html_col]
    p = _with_sections(outlined(pages, html_col))
    headings = lambda field: RIVAL_HEADINGS[field]
    given = _first(F.filter("o.metas", lambda m: F.lower(m["name"]) == "description")).content
    from_meta = lambda pattern: text.delimited(text.empty_to_null(F.regexp_extract(given, pattern, 1)))
    words = lambda field: text.normalise(F.array_join(section_values(F.col("sections"), *headings(field)), " "))
    listed = lambda field, found=None: F.coalesce(*([F.when(F.size(found) > 0, found)] if found is not None else []), section_list(F.col("sections"), *headings(field)), F.array().cast("array<string>"))
    attribute = lambda *names: _first(F.filter(F.transform(F.filter("o.data", lambda d: d["name"].isin(*names)), lambda d: text.normalise(d.value)), lambda v: v.isNotNull()))
    marked = lambda field: F.transform(F.filter("o.parts", lambda x: x.mark.isin(RIVAL_MARKS[field])), lambda x: text.normalise(x.text))
    meta = lambda name: text.normalise(_first(F.filter("o.metas", lambda m: m["name"] == name)).content)
    bare = lambda c: F.regexp_replace(c, "(?i)^tel:", "")
    calls = F.filter("o.links", lambda a: F.coalesce(a.href.startswith("tel:"), F.lit(False)) | a.tel.isNotNull())
    tel = F.filter(F.transform(calls, lambda a: F.coalesce(text.empty_to_null(text.spaces(a.text)), text.normalise(bare(a.tel)), text.normalise(bare(a.href)))), lambda x: x.isNotNull())
    digits = lambda c: text.empty_to_null(F.regexp_extract(c, r"(\d{5,8})", 1))
    mail = F.transform(F.filter("o.links", lambda a: a.href.startswith("mailto:")), lambda a: F.trim(F.try_url_decode(F.regexp_replace(a.href, r"^mailto:|\?.*$", ""))))
    sites = F.transform(F.filter("o.links", lambda a: a.href.startswith("http") & F.lower(a.text).contains("website")), lambda a: a.href)
    fields = {
        "name": F.coalesce(text.normalise(F.regexp_extract(given, r"Name:\s*([^,]+)", 1)), text.normalise(F.regexp_extract("o.title", r"^([^:|]+)", 1)), attribute("data-consultant-name"), _first(marked("name"))),
        "registration_number": F.coalesce(
            text.registration_number(attribute("data-clipboard-text")),
            text.registration_number(digits(F.array_join(section_values(F.col("sections"), *headings("registration")), " "))),
            text.registration_number(digits(F.regexp_extract("o.body", r"(?i)GMC\s*(?:number|no\.?|registration)?\s*:?\s*(\d{5,8})", 0))),
            text.registration_number(meta("gmc-number")),
            text.registration_number(attribute("data-gmc", "data-gmc-number", "data-registration-number")),
        ),
        "has_photo": F.exists("o.images", lambda i: i.src.startswith("http") & (F.lower(i.alt) == F.lower(F.regexp_extract(given, r"Name:\s*([^,]+)", 1)))),
        "about_text": F.coalesce(words("about_text"), _first(F.filter(marked("about_text"), lambda x: F.length(x) > 20))),
        "specialty_primary": listed("specialty_primary", from_meta(r"(?i),\s*specialty:\s*(.*?)(?:,\s*subspecialty:|$)")),
        "specialty_sub": listed("specialty_sub", from_meta(r"(?i)subspecialty:\s*(.*)$")),
        "treatments": listed("treatments"),
        "qualifications": text.empty_to_null(F.concat_ws(" ", words("qualifications"), words("training"))),
        "memberships": listed("memberships"),
        "clinical_interests": listed("clinical_interests"),
        "languages": listed("languages"),
        "hospitals": F.when(F.size(listed("hospitals")) > 0, listed("hospitals")).otherwise(F.coalesce(F.array_distinct(F.filter(marked("hospitals"), lambda x: x.isNotNull())), F.array().cast("array<string>"))),
        "fee_assured": F.when(F.exists("o.marks", lambda m: m.contains("not-fee-assured")), False).when(F.exists("o.marks", lambda m: m.contains("fee-assured")), True),
        "phones": F.array_distinct(tel),
        "emails": F.array_distinct(mail),
        "websites": F.array_distinct(sites),
        "badges": F.array_distinct(F.transform(F.filter("o.images", lambda i: F.lower(i.alt).contains(badge)), lambda i: i.alt)),
    }
    mapped = F.array_distinct(F.transform(F.array(*[F.lit(h) for hs in RIVAL_HEADINGS.values() for h in hs]), text.section_key))
    return p.select(*kept, *[v.alias(k) for k, v in fields.items()], "sections", F.array_except(F.map_keys("sections"), mapped).alias("unmapped"))
