"""Problem 4: unfilled templates, filler text, and pages that are only an error message or a notice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize, small_enough

NAME = r"[A-Za-z][\w.\- \x{A0}]{0,60}"
#: Shapes of a variable that nothing else has; the name is what stands inside.
SURE_VARIABLE = "|".join(
    [
        r"\{\{\{?[^{}]{1,80}\}\}",  # {{name}}
        r"\{%[^{}%]{1,80}%\}",  # {% name %}
        r"\$\{[^{}]{1,80}\}",  # ${name}
        r"<%[=\-#]?[^<>%]{1,80}%>",  # <%= name %>
        rf"%%\s*{NAME}\s*%%",  # %%name%%
        rf"\[\[\s*{NAME}\s*\]\]",  # [[name]]
        r"(?<![\w])__[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*__(?!\w)",  # __name__
        r"\*\|[A-Za-z_:]{2,40}\|\*",  # *|NAME|*
        r"@@[A-Za-z_]{2,40}@@",
        r"(?<![\w%])%[A-Z][A-Z_]{2,40}%(?!\w)",  # %NAME%
        r"\{[A-Za-z_][A-Za-z0-9_.]{0,60}\}",  # {name}
        r"\[[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+)*\]",  # [NAME], [CTA BUTTON]
        r"\[[a-z][a-z0-9]*(?:_[a-z0-9]+)+\]",  # [first_name]
        r"(?i:\[(?:insert|add|enter|your|replace|type|write|describe)\b[^\[\]]{1,80}\])",  # [insert headline here]
    ]
)
#: Any other marks around a name; they count when the name is retained in unmistakable marks or in an unfilled page elsewhere in the corpus.
LIKELY_VARIABLE = r"(?<![\[\w])\[\s*([\p{L}][\p{L}\p{N}_ ]{1,40}?)\s*\](?![\](])|<{1,3}\s*([\p{L}_][\p{L}\p{N}_.\- ]{1,40}?)\s*>{1,3}|\{{1,3}\s*([\p{L}_][\p{L}\p{N}_.\- ]{1,40}?)\s*\}{1,3}|([#%$@|~^*=])\4?([\p{L}][\p{L}\p{N}_.\-]{1,40})\4{1,2}(?!\w)|\$([A-Z][A-Z0-9_]{1,40})\b"
#: Characters without one of which there is no variable.
MARKS = r"[{\[%*@]|__"
LIKELY_MARKS = r"[{\[<#%$@|~^*=]"

#: Defaults that a template leaves where nothing was filled in. Whole short blocks.
DEFAULT_TEXT = r"(?i)^\W*(?:(?:your|the|a|an)?\s*(?:\w+\s+)?(?:headline|heading|title|subtitle|text|name|logo|tagline|slogan|description|content|caption|image|copy|quote|button text)\s+(?:goes\s+)?here|(?:add|enter|type|write|insert|edit)\s+your\s+(?:\w+\s+){0,3}(?:here|(?:in|into) th\w+ (?:text )?(?:box|field|area|section|block))|(?:this is )?(?:an? |the )?(?:example|sample|dummy|placeholder|default) (?:page|paragraph|text|heading|post|block|content|title)|(?:todo|tbd|fixme|tbc)\b\s*(?:[:\-–—].*)?|.*\b(?:replace|change|edit|delete) (?:it|this|this text|me) before (?:launch|publishing|going live|release)\b.*|x{3,}\s+per\s+\w+|lorem ipsum)\W*$"

#: Words of the usual filler texts. Fixed values.
FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat proident culpa officia deserunt mollit anim est laborum vestibulum maecenas pellentesque suspendisse ut et "
    "foo bar baz qux asdf qwer qwerty zxcv hjkl xxxx blah dummy placeholder tbd sample wording"
).split()
#: Words that fill up keyboard filler without being filler by themselves.
FILLED_UP = "test text copy goes here".split()
FILLER_SHARE, FILLER_LEAST = 0.5, 5

#: Said by a page that is only an error message or a notice.
STRONG_NOTICE = r"(?i)(?:page|address|document|file|url|link|item|resource|article|content|site)(?: \w+){0,5} (?:not (?:be )?found|(?:does not|doesn't|no longer) exists?|(?:is|was|has been)(?: \w+)? (?:gone|broken|removed|moved|unpublished|unavailable|deleted|expired)|(?:is )?no longer available|has (?:expired|moved))|(?:not|can't|cannot|couldn't|could not) find (?:that|the|this|what)|(?:page|file) not found|nothing (?:to see )?here|something went wrong|(?:an? )?(?:unexpected|internal|server|fatal) (?:server )?error|error (?:establishing|code|\d{3})|access (?:is |was )?(?:denied|forbidden|restricted)|(?:not|do not|don't|no) (?:have )?(?:permission|authori[sz]ed|allowed) to|forbidden|(?:service|site|temporarily|currently|server) (?:is )?(?:temporarily |currently )?unavailable|(?:down|closed|offline) for (?:\w+ )?maintenance|(?:under|planned|scheduled) maintenance|(?:gateway|request|connection|server) (?:has )?timed? ?out|took too long to (?:answer|respond)|bad gateway|too many requests|rate limit exceeded|database connection|check(?:ing)? (?:if )?(?:your|the) (?:browser|connection)|are you (?:a )?(?:person|human|robot)|(?:verify|confirm|prove) (?:that )?you(?:'re| are) (?:a )?(?:not a robot|human|person)|(?:enable|activate|allow|turn on|switch on|require[sd]?|needs?|without|support)(?: \w+){0,4} (?:javascript|java script|scripts?|scripting)|(?:javascript|java script|scripts?|scripting)(?: \w+){0,4} (?:disabled|enabled|required|switched off|turned off|turned on|on|allowed|off)|(?:cookies|scripts) before it lets|just a moment|one moment while"
#: Words of which a page that recurs on several sites has one when it is a notice.
WEAK_NOTICE = r"(?i)\b(?:404|410|403|401|500|502|503|504|error|errors|oops|sorry|denied|forbidden|unavailable|maintenance|expired|removed|unpublished|broken|missing page|javascript|scripts?|scripting|captcha|robot|timed out|went wrong|try again|reload|refresh|webmaster|does not exist|not found|can't find|permission|no longer)\b"
#: A page that no other is like, with more words than this or more characters, is not only a notice, whatever its words.
NOTICE_WORDS, NOTICE_CHARS = 60, 800
#: A text is part of a template from so many pages and sites on. A page of nothing else is an unfilled or an error page when
#: it has no more words than SHORT, when this share of the pages with its texts failed, or when it says so.
TEMPLATE_PAGES, TEMPLATE_SITES, FAILED_SHARE, SHORT = 3, 2, 0.2, 60
#: Rows of a long or a short name that may be broadcast: some 10 MB.
BROADCAST_ROWS = 100_000
WORDS = r"[\p{L}\p{N}]+"
#: A text of more words than NOTICE_WORDS may speak of errors, but does not say that there is one.
SHORT_TEXT = rf"^[^\p{{L}}\p{{N}}]*(?:[\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]*){{0,{NOTICE_WORDS}}}+$"


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")


def _text(c: Column) -> Column:
    """No-break and other Unicode spaces as plain ones."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\p{Z}\s]+", " ")


def _is_filler(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    real = F.size(F.filter(words, lambda w: w.isin(FILLER)))
    # keyboard filler: its own words, and as many as half again that only fill up
    up = F.size(F.filter(words, lambda w: w.isin(FILLED_UP)))
    n = F.size(words)
    looks = F.regexp_count(F.lower(text), F.lit(r"\b(?:" + "|".join(w for w in FILLER if len(w) > 2) + r")\b")) >= 2
    return F.when(looks, (n >= FILLER_LEAST) & ((real >= FILLER_SHARE * n) | ((real >= 0.3 * n) & (real + up >= 0.8 * n)))).otherwise(False)


def _held(df: DataFrame, tag: str) -> DataFrame:
    df = materialize(df, tag)
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


def residue(pages: DataFrame, page_id: str, site: Column, blocks: str, status: str, failure: str) -> DataFrame:
    """(page_id, reasons): pages with an unfilled slot outside code (`variable`), a template's default or filler text (`default`,
    `filler`), that are an unfilled template altogether (`template`), or nothing but an error message or notice (`notice`).

    Alignment. A page's content blocks (all but code and blocks that are links altogether) are masked by the site's name, numbers
    and names in marks, which are the slots two pages of one template differ in, and hashed. A text that is the same on
    TEMPLATE_PAGES pages and TEMPLATE_SITES sites is a template's own; one that recurs on as many pages of one site only
    is that site's furniture. A page with template texts and no content beside them and furniture was never filled: it
    is flagged when it is short altogether and one site shows it on TEMPLATE_PAGES pages, when for most of their words FAILED_SHARE of the pages with them failed (status
    of 400 or more, or a failure reason), or when most say that something is wrong. No words are needed for the first two, so
    the language does not matter, nor the length for the last two.
    Slots. A name in unmistakable marks is a slot that retains its variable's name. The names retained anywhere, there
    or in marks of any shape on unfilled pages, are the variables of the corpus; a slot in marks that ordinary text uses
    too ([city], <<city>>) is unfilled when its name is one of them. A default is flagged by its words.
    Last, a page like no other has to say outright that it is a notice, in at most NOTICE_WORDS words.

    Pages without id give no rows, pages without blocks and null or blank texts have no content; pages delivered twice
    count once; a null site is a site of its own; an empty table gives an empty result; other columns are not touched.
    """
    kind = lambda b: F.coalesce(b["kind"], F.lit(""))
    none = F.array().cast("array<string>")
    src = pages.where(F.col(page_id).isNotNull()).select(F.col(page_id).alias("page_id"), F.coalesce(site, F.lit("")).alias("site"), F.coalesce(F.col(blocks), F.array()).alias("b"), F.col(status).cast("string").alias("status"), F.col(failure).alias("failure"))
    whole = lambda b: F.concat_ws(" ", b["text"], F.array_join(b["cells"], " | "))
    marked = lambda t: t.rlike(MARKS) & t.rlike(SURE_VARIABLE)
    outside = F.filter("b", lambda b: kind(b) != "code")
    is_default = F.exists("out", lambda b: F.coalesce(_text(b["text"]).rlike(DEFAULT_TEXT), F.lit(False)))
    is_filler = F.exists("b", lambda b: F.coalesce(_is_filler(whole(b)), F.lit(False)))
    linked = lambda b: (F.size(F.coalesce(b["anchors"], F.array())) > 0) & (_letters(F.coalesce(b["text"], F.lit(""))) == _letters(F.array_join(F.transform(b["anchors"], lambda a: a["label"]), "")))
    content = F.filter("out", lambda b: ~linked(b) & (F.length(F.trim(_text(whole(b)))) > 0))
    size = F.aggregate("out", F.lit(0), lambda s, b: s + F.when(F.size(F.coalesce(b["anchors"], F.array())) > 0, 0).otherwise(F.coalesce(F.length(b["text"]), F.lit(0)) + F.coalesce(F.length(F.array_join(b["cells"], " ")), F.lit(0))))
    has_code = F.exists("b", lambda b: (kind(b) == "code") & (F.length(F.trim(_text(b["text"]))) > 0))
    labels = F.split("site", r"\.")
    brand = F.lower(F.when(F.size(labels) > 1, F.element_at(labels, -2)).otherwise(F.col("site")))
    in_marks = lambda t: F.filter(F.transform(F.split(F.regexp_replace(t, LIKELY_VARIABLE, "\u0001$1$2$3$5$6\u0001"), "\u0001"), lambda x, k: F.when(k % 2 == 1, _letters(x))), lambda x: F.length(x) > 1)
    plain_marks = lambda t: F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    likely = lambda t: F.when(t.rlike(LIKELY_MARKS) | t.contains("&lt;"), in_marks(plain_marks(t))).otherwise(none)
    sure = lambda t: F.when(marked(t), F.transform(F.regexp_extract_all(t, F.lit(f"({SURE_VARIABLE})"), F.lit(1)), _letters)).otherwise(none)
    masked = lambda t: F.regexp_replace(F.regexp_replace(F.when(F.length("brand") > 2, F.replace(F.lower(t), F.col("brand"), F.lit("\u00a7"))).otherwise(F.lower(t)), r"\p{N}+", "0"), r"[^\p{L}0\u00a7]+", "")
    src = src.withColumns({"out": outside, "brand": brand}).withColumn("texts", F.transform(content, whole))
    flags = src.select(
        "page_id", "site", F.exists("out", lambda b: marked(whole(b))).alias("variable"), is_default.alias("default"), is_filler.alias("filler"), has_code.alias("code"),
        F.flatten(F.transform("texts", sure)).alias("names"), F.flatten(F.transform("texts", likely)).alias("likely"),
        F.coalesce((F.expr("try_cast(trim(status) as double)") >= 400) | (F.length(F.trim("failure")) > 0), F.lit(False)).alias("failed"),
        F.when((size <= NOTICE_CHARS) & ~has_code, F.trim(_text(F.array_join("texts", " \n ")))).alias("message"),
        F.transform("texts", lambda t: F.struct(F.xxhash64(masked(t)).alias("h"), F.regexp_count(t, F.lit(WORDS)).alias("words"), (t.rlike(SHORT_TEXT) & t.rlike(STRONG_NOTICE)).alias("says"))).alias("texts"),
    )
    flags = flags.withColumn("message", F.when((F.length("message") > 0) & (F.regexp_count("message", F.lit(WORDS)) <= NOTICE_WORDS), F.col("message")))
    flags = materialize(flags, "residue")

    parts = flags.where("not code").select("page_id", "site", "failed", F.explode(F.array_distinct("texts")).alias("t")).select("page_id", "site", "failed", "t.h", "t.words", "t.says")
    each = parts.groupBy("h", "site", "page_id").agg(F.max("failed").alias("failed"))
    sites = each.groupBy("h", "site").agg(F.count("*").alias("pages"), F.sum(F.col("failed").cast("int")).alias("failures"))
    texts = sites.groupBy("h").agg(F.sum("pages").alias("pages"), F.count("*").alias("sites"), F.sum("failures").alias("failures"), F.max("pages").alias("most"))
    shared = _held(texts.where((F.col("pages") >= TEMPLATE_PAGES) & (F.col("sites") >= TEMPLATE_SITES)).select("h", (F.col("failures") >= FAILED_SHARE * F.col("pages")).alias("bad"), (F.col("most") >= TEMPLATE_PAGES).alias("often")), "templates")
    furniture = _held(sites.where(F.col("pages") >= TEMPLATE_PAGES).select("h", "site", F.lit(True).alias("own")), "sitetexts")
    told = parts.join(shared, "h", "left").join(furniture, ["h", "site"], "left")
    in_template = F.col("bad").isNotNull()
    unfilled = told.groupBy("page_id").agg(
        F.min(in_template | F.col("own").isNotNull()).alias("all"), F.max(in_template).alias("any"), F.sum(F.when(in_template, F.col("words")).otherwise(0)).alias("words"), F.sum("words").alias("all_words"), F.min(F.coalesce("often", F.lit(True))).alias("often"),
        F.sum(F.when(F.col("bad"), F.col("words")).otherwise(0)).alias("bad"), F.sum(F.when(in_template & F.col("says"), F.col("words")).otherwise(0)).alias("says"),
    )
    unfilled = unfilled.withColumns({c: 2 * F.col(c) > F.col("words") for c in ("bad", "says")})
    unfilled = materialize(unfilled.where(F.col("all") & F.col("any") & (F.col("bad") | F.col("says") | (F.col("often") & (F.col("all_words") <= SHORT)))).select("page_id", F.when(F.col("bad") | F.col("says"), "notice").otherwise("template").alias("reason")), "unfilled")

    empty = flags.join(F.broadcast(unfilled) if small_enough(unfilled, BROADCAST_ROWS) else unfilled, "page_id", "left_semi").where("size(likely) > 0").select("page_id", F.explode("likely").alias("name"))
    retained = flags.where("variable").select("page_id", F.explode("names").alias("name")).union(empty).where("name <> ''").distinct()
    names = _held(retained.groupBy("name").agg(F.count("*").alias("n")).where("n >= 2").select("name"), "names")
    slots = flags.where("not variable and size(likely) > 0").select("page_id", F.explode("likely").alias("name")).join(names, "name", "left_semi").select("page_id", F.lit("variable").alias("reason"))
    alone = flags.where("message is not null").where(F.col("message").rlike(STRONG_NOTICE) | (F.col("failed") & F.col("message").rlike(WEAK_NOTICE))).select("page_id", F.lit("notice").alias("reason"))
    plain = flags.select("page_id", F.explode(F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("variable", "default", "filler")]), lambda x: x.isNotNull())).alias("reason"))
    return plain.unionByName(slots).unionByName(unfilled).unionByName(alone).groupBy("page_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons")).select(F.col("page_id").alias(page_id), "reasons")
