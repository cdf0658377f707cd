"""Problem 5: defective question-answer pairs, by ordered rules. All rules are built-in expressions; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order in which the rules are applied; p5_found gives the first that holds.
DEFECTS = ("empty", "refusal", "copied_question", "other_language", "truncated")

#: Stand-ins for a missing answer, in lower case without brackets, quotes and marks. A bare "none" or "no" is an answer.
STAND_INS = ("null", "nil", "undefined", "nan", "n/a", "na", "n.a", "tbd", "tba", "todo", "no answer", "no response", "empty", "blank", "missing", "keine antwort", "pas de réponse", "sin respuesta", "not available")

#: Phrases of refusal, as patterns on the lower-case answer, at the start of one of its sentences.
REFUSALS = (
    # English
    r"(?:i'?m|i am|we'?re|we are)? ?(?:very |so |really )?(?:sorry|afraid)\b[^.!?]{0,40}\b(?:can'?t|can ?not|won'?t|unable|not able|not allowed|must decline|don'?t|do not)\b",
    r"(?:i|we) (?:can'?t|can ?not|won'?t|will not|could not|am unable to|'?m unable to|am not able to|'?m not able to|am not allowed to|'?m not allowed to|must|have to|would have to|respectfully|refuse to|decline to|would rather not|prefer not to)\b[^.!?]{0,30}\b(?:help|answer|assist|comment|share|discuss|provide|disclose|say|respond|reply|decline|refuse|comply|talk)\b",
    r"i'?d rather not\b",
    r"i(?: must)? (?:respectfully )?decline\b",
    r"as an? (?:ai |language )?(?:assistant|model|ai|language model|ai model)\b[^.!?]{0,20}\b(?:not|can'?t|cannot|unable|won'?t|decline)\b",
    r"unfortunately,? (?:i|we) (?:don'?t|do not|can'?t|can ?not|am|are|'m|won'?t)\b",
    r"(?:my|our|the) (?:guidelines|policy|policies|rules|instructions)\b[^.!?]{0,20}\b(?:not allow|don'?t allow|forbid|prohibit|prevent|not permit)",
    r"(?:that|this) (?:is|'s) (?:not something|nothing) (?:i|we) (?:can|may|am|could)\b",
    r"it would(?: not|n'?t) be (?:appropriate|right|proper)\b",
    r"(?:this|that) (?:request|question) (?:can ?not|can'?t) be (?:answered|fulfilled)\b",
    # German
    r"(?:es tut mir (?:sehr )?leid|tut mir leid|entschuldigung|leider|bedauere)\b[^.!?]{0,60}\b(?:nicht|keine|nichts|kein)\b",
    r"[^.!?]{0,40}\b(?:kann|darf|möchte|will|werde) ich\b[^.!?]{0,40}\b(?:nicht (?:beantworten|helfen|sagen|antworten|weiterhelfen|teilen|äußern)|keine (?:auskunft|antwort|angaben)|nichts (?:sagen|dazu))",
    r"ich (?:kann|darf|möchte|will|werde|muss)\b[^.!?]{0,50}\b(?:nicht (?:beantworten|helfen|sagen|antworten|weiterhelfen|teilen|äußern)|keine (?:auskunft|antwort|angaben)|nichts (?:sagen|dazu)|ablehnen)",
    r"als (?:ki-?)?(?:assistent|assistentin|sprachmodell|modell)\b[^.!?]{0,50}\b(?:nicht|keine?)\b",
    # French
    r"(?:je suis |toutes mes )?(?:désolée?|navrée?|excuses)\b[^.!?]{0,30}\b(?:ne|n')",
    r"malheureusement,? je (?:ne|n')",
    r"je (?:ne|n') ?(?:peux|puis|suis|souhaite|veux|saurais)\b[^.!?]{0,20}\b(?:pas )?[^.!?]{0,20}\b(?:répondre|aider|parler|dire|partager|autorisée?|communiquer|commenter|fournir|divulguer)",
    r"je préfère ne pas\b",
    r"en tant qu[e'] ?(?:assistante?|modèle|ia|intelligence)\b[^.!?]{0,20}\b(?:ne|n')",
    r"il ne m'est pas (?:possible|permis)\b",
    # Spanish
    r"(?:lo siento|lo lamento|lamentablemente|desafortunadamente|disculpa|perdón|por desgracia)\b[^.!?]{0,40}\bno\b",
    r"no (?:puedo|me es posible|estoy autorizad[oa]|estoy en condiciones|debo|quiero|podré)\b[^.!?]{0,20}\b(?:ayudar|responder|contestar|dar|decir|compartir|comentar|hablar|proporcionar|facilitar)",
    r"prefiero no\b",
    r"como (?:asistente|modelo|ia)\b[^.!?]{0,20}\bno\b",
)

#: Function words that stand for one of the languages only.
FUNCTION_WORDS = {
    "en": "the and is are was were of to which it because then that this with from what why how does did who when where has had been not but for only they there its into keep things remain most them all before after next must needs yes".split(),
    "de": "der die das und ist sind nicht wurde wurden weil auch noch welche warum wie mit für den dem ein eine einen auf bei nach zu zum zur hat hatte danach dann kam zuerst wieder also vor als nur fehlt muss werden direkt neben wird aber oder".split(),
    "fr": "le les et est sont une des dans pas pour que qui avec sur par pourquoi quel quelle combien reste plus puis été être du au aux il elle nous parce encore ensuite doit juste côté toutes était premier première c qu d l".split(),
    "es": "el los las y por con una para que del fue qué cuántas cuál archivo está están estaba porque todavía pero luego después ser debe queda lado al justo todas primera mitad llegó sin según cuando hay".split(),
}

_PREFIX = r"^(?:q|question|you asked|the question (?:is|was)|your question(?: is| was)?|frage|die frage (?:ist|war|lautete?)|la question (?:est|était)|vous avez demandé|la pregunta (?:es|era)|pregunta|preguntaste|du hast gefragt) ?[:：] ?"
_TAIL = r"""[)\]}"'`*_»“”’\s​]*$"""


def _words_only(c: Column) -> Column:
    """Lower case, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def _prose(c: Column) -> Column:
    """Text without code spans, quotations, paths and names, in lower case."""
    c = F.regexp_replace(c, r"```[\s\S]*?(?:```|$)|`[^`]*`|\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“]*“", " ")
    c = F.regexp_replace(c, r"\S*[/_\\]\S*|\b\p{L}+\p{Ll}\p{Lu}\S*|\b\S+\.(?:\p{L}{2,4})\b", " ")
    return F.lower(c)


def _tokens(prose: Column) -> Column:
    return F.regexp_extract_all(prose, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _hits(tokens: Column, lang: str) -> Column:
    """How many of the words are function words of the language."""
    return F.size(F.filter(tokens, lambda w: w.isin(*FUNCTION_WORDS[lang])))


def _script(c: Column) -> Column:
    """The share of letters that are not Latin."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(c, r"[^\p{L}]|\p{IsLatin}", "")) / letters).otherwise(0.0)


def with_defects(pairs: DataFrame, q: str = "q", a: str = "a", out: str = "defects") -> DataFrame:
    """pairs with a column out: array of all defects of the answer, in the order of DEFECTS; empty for a sound pair.

    - empty: null, nothing visible, or a stand-in for a missing answer.
    - refusal: a sentence begins with a phrase that declines, in English, German, French or Spanish; quotations do not count.
    - copied_question: once or more the question, case, marks and a heading aside, or a beginning of it with five words or more, and nothing else.
    - other_language: function words of another language than the question's prevail, or letters of another script.
    - truncated: a bracket, code fence, code span, quotation or tag is left open, or a sentence has no end; bare values and names, stand-ins and
      whole copies of the question need none.

    Rules are applied side by side, so an answer has every defect that holds. A null question is no question: nothing is copied from it or in its language. Equal rows have
    equal results; other columns pass through, and a column named out is replaced.
    """
    mine = "_d_"
    while any(x.lower().startswith(mine) for x in pairs.columns):
        mine += "_"
    c = lambda n: F.col(f"{mine}{n}")
    staged = pairs

    def stage(**columns: Column) -> None:
        """Columns of a step, each worked out once for a row."""
        nonlocal staged
        staged = staged.withColumns({f"{mine}{n}": x for n, x in columns.items()})

    stage(q=F.coalesce(F.col(q).cast("string"), F.lit("")), a=F.coalesce(F.col(a).cast("string"), F.lit("")))
    quoteless = F.regexp_replace(F.regexp_replace(c("a"), "[’‘]", "'"), r"\"[^\"]*\"|“[^”]*”|«[^»]*»", " quoted ")
    stem = F.regexp_replace(c("q"), r"^[¿\s]+|[\s?.!]+$", "")
    stage(
        visible=F.trim(F.regexp_replace(c("a"), r"[\s\p{Z}\p{C}]+", " ")),
        flat=F.trim(F.regexp_replace(F.lower(quoteless), r"\s+", " ")),
        rest=F.regexp_replace(c("a"), r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""),
        stem=stem,
        qw=_words_only(c("q")),
    )
    mark = r"[\s\[\](){}<>\"'`*_.…:;,–—-]+"
    behind = F.trim(F.substring(c("rest"), F.length(c("stem")) + 2, F.length(c("rest"))))
    stage(
        bare=F.trim(F.regexp_replace(F.trim(F.lower(F.regexp_replace(c("visible"), r"</?\w+ ?/?>", ""))), f"^{mark}|{mark}$", "")),
        aw=_words_only(F.regexp_replace(F.lower(c("visible")), _PREFIX, "")),
        # what an answer says behind a repeated question
        rest=F.when((c("stem") != "") & F.startswith(c("rest"), F.concat(c("stem"), F.lit(":"))), behind).otherwise(c("rest")),
    )
    stage(qp=_tokens(_prose(c("q"))), ap=_tokens(_prose(c("rest"))), open=F.regexp_replace(c("rest"), r"```[\s\S]*?```", ""))
    langs = sorted(FUNCTION_WORDS)
    stage(**{f"{side}_{x}": _hits(c(f"{side}p"), x) for side in "qa" for x in langs})
    best = lambda side: F.greatest(*[F.struct(c(f"{side}_{x}").alias("n"), F.lit(x).alias("lang")) for x in langs])
    stage(q_best=best("q"), a_best=best("a"), twice=F.trim(F.replace(F.concat(c("aw"), F.lit(" ")), F.concat(c("qw"), F.lit(" ")), F.lit(""))))

    empty = (c("bare") == "") | c("bare").isin(*STAND_INS)
    refusal = c("flat").rlike(r"(?U)(?:^|[.!?:] )[\s¡¿*_>-]*(?:" + "|".join(REFUSALS) + ")")
    part = (F.size(F.split(c("aw"), " ")) >= 5) & F.startswith(F.concat(c("qw"), F.lit(" ")), F.concat(c("aw"), F.lit(" ")))
    copied = (c("qw") != "") & (c("aw") != "") & ((c("twice") == "") | part)
    own = sum((F.when(c("q_best")["lang"] == x, c(f"a_{x}")).otherwise(0) for x in langs), F.lit(0))
    other = (c("q_best")["n"] > 0) & (c("a_best")["lang"] != c("q_best")["lang"]) & (c("a_best")["n"] >= 2) & (c("a_best")["n"] > own)
    other = other | (F.abs(_script(c("q")) - _script(c("a"))) > 0.5)

    count = lambda x: F.length(c("open")) - F.length(F.replace(c("open"), F.lit(x), F.lit("")))
    unclosed = (
        ((F.size(F.split(c("rest"), "```")) - 1) % 2 == 1)
        | (count("`") % 2 == 1)
        | (count("(") > count(")"))
        | (count("[") > count("]"))
        | (count("{") > count("}"))
        | (count('"') % 2 == 1)
        | (count("“") + count("«") > count("”") + count("»"))
        | (F.regexp_count(c("open"), F.lit(r"<(?![/!?])\w[^<>]*(?<!/)>")) > F.regexp_count(c("open"), F.lit(r"</\w+>")))
        | c("open").rlike(r"<\/?\w*$")
    )
    value = c("rest").rlike(r"(?U)^[`\"'*]*(?:[^\s,;:]+|[-+]?[\d.,:%]+ ?\p{L}*|[\d.,]+ \p{L}+)[`\"'*]*$")
    code = c("rest").rlike(r"```\s*$") | c("rest").rlike(r"(?s)^\{.*\}$|^\[.*\]$|^<(\w+).*>$")
    ended = F.regexp_replace(c("rest"), _TAIL, "").rlike(r"[.!?…。！？]$") | c("rest").rlike(r"[.!?…。！？]" + _TAIL)
    whole = empty | (copied & (c("twice") == ""))  # a stand-in or a whole question needs no end of its own
    truncated = (c("rest") != "") & (unclosed | ~(ended | value | code | whole))

    stage(empty=empty, refusal=refusal, copied=copied, other=other, truncated=truncated)
    rules = (("empty", c("empty")), ("refusal", c("refusal")), ("copied_question", c("copied")), ("other_language", c("other")), ("truncated", c("truncated")))
    staged = staged.withColumn(out, F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in rules])))
    return staged.drop(*[x for x in staged.columns if x.startswith(mine)])


def defective(pairs: DataFrame, id_col: str = "probe_id") -> DataFrame:
    """(id, defect): each defective pair with the first defect by the order of DEFECTS."""
    return _exploded(with_defects(pairs, out="_defects"), id_col, F.slice("_defects", 1, 1))


def all_defects(pairs: DataFrame, id_col: str = "probe_id") -> DataFrame:
    """(id, defect): every defect of every pair."""
    return _exploded(with_defects(pairs, out="_defects"), id_col, F.col("_defects"))


def _exploded(d: DataFrame, id_col: str, defects: Column) -> DataFrame:
    """A filter on the defects themselves would be pushed below the steps and work all of them out again for each use."""
    return d.select(id_col, F.explode_outer(defects).alias("defect")).where("defect is not null")
