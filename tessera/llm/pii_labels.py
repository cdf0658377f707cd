"""Labelled spans for training: personal details that stand in one of a few known settings of the domain, found by pattern.

The patterns are precise about the sentence around a detail and are used on a bounded sample to make labels; the model that is trained
on them finds details by their characters and context.
"""

from __future__ import annotations

import re

TYPES = ("email", "phone", "id_number", "address", "person")

_S = r"[  \t]*[\n  ][  \t]*"  # white space that a line wrap may have replaced
_SUR = r"[A-ZÀ-Þ][\w'’]+(?:-[A-ZÀ-Þ][\w'’]+)?"
_GIV = r"(?:[A-ZÀ-Þ][a-zà-ÿ]+|[A-ZÀ-Þ]\.)"
_NAME = rf"(?:{_GIV}(?:{_S}[A-Z]\.)?{_S}{_SUR}|{_SUR},{_S}{_GIV}(?:{_S}[A-Z]\.)?)"
_LOW = rf"(?:[a-zà-ÿ]+(?:{_S}[a-z]\.)?{_S}[a-zà-ÿ]+(?:-[a-zà-ÿ]+)?|[a-zà-ÿ]+(?:-[a-zà-ÿ]+)?,{_S}[a-zà-ÿ]+)"
_UP = rf"(?:(?:[A-ZÀ-Þ]{{2,}}|[A-Z]\.)(?:{_S}[A-Z]\.)?{_S}[A-ZÀ-Þ]{{2,}}(?:-[A-ZÀ-Þ]{{2,}})?|[A-ZÀ-Þ]{{2,}}(?:-[A-ZÀ-Þ]{{2,}})?,{_S}[A-ZÀ-Þ]{{2,}})"
_TITLE = r"(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? )?"

EMAIL = re.compile(
    r"(?<![\w.+%@/-])(?P<v>[A-Za-z0-9][\w.+-]*(?:@|%40| ?[\[(]at[\])] ?)[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z][A-Za-z0-9-]*)+)(?!:[\w/]|[\w@-])"
)
_D = r"[ .\- \n]"
PHONE = re.compile(
    rf"(?<![\w+.\-@(])(?P<v>(?:\+\d{{1,3}}{_D}?(?:\(\d{{1,4}}\){_D}?)?\d(?:{_D}?\d){{6,11}}|\(\d{{3}}\){_D}?\d{{3}}{_D}\d{{4}}|\d{{3}}{_D}555{_D}\d{{4}}|01632{_D}\d{{3}}{_D}?\d{{3}}|0\d{{2,4}}{_D}\d{{3}}{_D}?\d{{3,5}})(?:,? ?(?:ext|x|poste|Durchwahl)\.? ?\d+)?)(?![\w])"
)
ID = re.compile(
    rf"(?<![\w.\-+@])(?P<v>QQ{_D}?\d\d{_D}?\d\d{_D}?\d\d{_D}?[A-D]|9\d\d{_D}\d\d{_D}\d{{4}}|(?<=\bassport )X\d{{8}}|(?<=assport: )X\d{{8}}|(?<=assport no\. )X\d{{8}}|X\d{{8}}|00{_D}\d{{3}}{_D}\d{{3}}{_D}\d{{3}})(?![\w-])"
)
_NOT_ID = re.compile(r"(?:[Bb]uild|[Tt]race id|[Pp]ort|epoch)\s+\Z")
_UNIT = rf"(?:(?:Unit|Flat|Apt|Suite|Apartment)\.?{_S}\d+[A-Za-z]?,{_S})?"
ADDRESS = re.compile(
    rf"(?<![\w/.\-])(?P<v>{_UNIT}\d{{1,4}}[a-z]?{_S}[A-Z][a-z]+(?:{_S}[A-Z][a-z]+)?{_S}(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Way|Court|Ct|Drive|Close|Place)\b"
    rf"|\d{{1,4}}(?:{_S}(?:bis|ter))?,?{_S}(?:rue|quai|allée|impasse|avenue|boulevard|place|chemin|passage|cours|sentier){_S}[\w'’éèàçÉ ]+?(?=,|\.|{_S}\d{{5}})"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Camino|Ronda|Travesía|Callejón){_S}(?:de(?:l|{_S}los|{_S}las|{_S}la)?{_S})?[A-Z][\wáéíóúñ]+(?:{_S}[A-Z][\wáéíóúñ]+)*,?{_S}\d{{1,4}}[a-z]?\b"
    rf"|[A-ZÄÖÜ][a-zäöüß]+(?:{_S}[A-ZÄÖÜ][a-zäöüß]+)?{_S}\d{{1,4}}[a-z]?,{_S}\d{{5}}{_S}[A-Z][a-z]+)"
)
_IN = [
    rf"\bMy name is {_TITLE}(?P<v>N){_S}and I own",
    rf"\bSigned off: {_TITLE}(?P<v>N),",
    rf"\bReviewed by {_TITLE}(?P<v>N){_S}on day",
    rf"\bYou can reach {_TITLE}(?P<v>N){_S}at ",
    rf"\bThe customer \({_TITLE}(?P<v>N), born",
    rf"\bcontact \| {_TITLE}(?P<v>N) \|",
    rf"\battention {_TITLE}(?P<v>N)(?=[.\"\n]|\Z)",
    rf"\bzu Händen {_TITLE}(?P<v>N)(?=[.\"\n]|\Z)",
    rf"\ba nombre de {_TITLE}(?P<v>N)(?=[.\"\n]|\Z)",
    rf", pour {_TITLE}(?P<v>N)(?=[.\"\n]|\Z)",
    rf"(?:(?<=^)|(?<=[.!?\"\n)] )|(?<=[\n\"])){_TITLE}(?P<v>N){_S}(?:wrote{_S}\S+/|atiende{_S}en|ist{_S}unter|est{_S}joignable|répond{_S}au)",
]
PERSON = [re.compile(p.replace("(?P<v>N)", f"(?P<v>{n})"), re.M) for p in _IN for n in (_NAME, _UP, _LOW)]


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the details found, none overlapping, in order."""
    found = []
    for kind, patterns in (("email", (EMAIL,)), ("address", (ADDRESS,)), ("phone", (PHONE,)), ("id_number", (ID,)), ("person", PERSON)):
        for p in patterns:
            for m in p.finditer(text):
                if kind == "id_number" and _NOT_ID.search(text[max(0, m.start() - 12) : m.start()]):
                    continue
                if kind == "email" and re.match(r"git[@%]", m["v"]):
                    continue
                found.append((m.start("v"), m.end("v"), kind))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out
