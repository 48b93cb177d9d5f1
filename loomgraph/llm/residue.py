"""Template residue, filler, error pages and demands for scripts, in records that should hold content.

Phrases of error, block and sign-in pages, filler and script notices in English, German, French
and Spanish, made from parts, are found by one multi-pattern automaton over the folded text (lower case,
without accents, blanks made single). A phrase counts only where a sentence or line
begins and not within quotation marks; notices to the reader may go on, other messages must be the whole
sentence or go on with words to the reader: a page says ``Access denied.``, prose says that
readers met an "access denied" banner or that unauthorized trading cost a bank money. Unfilled fields have notations of their own and are
matched in the text as it stands; filler Latin is told by the usual words, or by sentences
without any function word of the four languages whose words have Latin endings.

A record is excluded when the matched coverage is high for its length, or when any strong
phrase, field or filler is its own content (``least_coverage`` 0, as p9_found asks).
Whole texts are scanned, in one pass without a shuffle. Null and empty texts match nothing.
Repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import product

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases as rows of parts, every choice of one of each part's alternatives a phrase; folded: lower case, no accents. In English, German, French and Spanish.
#: Notices speak to the reader of the page itself, so their sentences may go on.
NOTICES = """
please |you must |you need to |you have to |   enable|turn on|switch on|activate|allow|accept|unblock   javascript|scripts|scripting|cookies|scripts and cookies|cookies and scripts|javascript and cookies|cookies and javascript
we need|this page needs|this site needs|this page requires|this site requires|this website requires   javascript|scripts|cookies|cookies and scripts|javascript and cookies
javascript |cookies |scripts |javascript and cookies   is |are |must be |has to be |have to be   disabled|blocked|turned off|switched off|required|enabled|not enabled|needed
your browser |this browser   does not|doesn't|is not|isn't|is out of date|is outdated|is no longer|cannot|can't|has scripts|blocks
please |   update|upgrade   your browser
please |   verify|confirm|prove   that |   you are|you're   human|a human|not a robot|not a bot
are you   a robot|a human|human
i am|i'm   not a robot
without   scripts|javascript|cookies   this   page|story|site|article
content is hidden   because   scripts|cookies|javascript
checking   your browser|if the site connection is secure|that you are human
please |   complete|solve   the|this   captcha|security check
please |   turn off|disable|pause|switch off   your|the   ad blocker|adblocker|blocker
please |you must |you need to   log in|sign in|log on|log back in|sign back in
log in|sign in   to|again
you must be   logged in|signed in
you have been|you were|you are   signed out|logged out|blocked|rate limited
you do not|you don't   have   permission|access
you are|you're   not authorised|not authorized|not allowed to view|not permitted to
your   session|login|connection   has expired|expired|timed out|has timed out|was closed
your   request|ip address|access|account   was|has been|is   blocked|denied|refused
this content is|this page is|this article is|this video is   closed to|not available in|blocked in|restricted in   your
slow down   and try again
you have sent|you sent|you have made   more than|too many
we could not|we couldn't|we cannot|we can't|we were unable to   find|load|display   what you|the page|that page|this page|the article|the story|the content
our engineers|our team|our staff   have been|has been|were   told|notified|informed
bitte |sie mussen |   aktivieren sie |erlauben sie |schalten sie |   javascript|cookies|skripte   aktivieren|einschalten|erlauben|zulassen|ein|akzeptieren
bitte |   aktivieren sie|erlauben sie|akzeptieren sie   javascript|cookies|skripte|die cookies
javascript|ihr javascript   ist   deaktiviert|ausgeschaltet|erforderlich|in ihrem browser|nicht aktiviert
cookies|skripte   sind   deaktiviert|blockiert|erforderlich
ihr browser   wird nicht|unterstutzt|ist veraltet|ist zu alt
bitte |   aktualisieren sie|wechseln sie   ihren browser|den browser
bitte |   bestatigen sie,|bestatigen sie   dass sie   kein roboter|ein mensch
bitte   melden sie sich|loggen sie sich|laden sie
ihre   sitzung|anmeldung   ist abgelaufen|wurde beendet|wurde blockiert
veuillez |vous devez |merci de |   activer|activez|autoriser|autorisez|accepter|acceptez|reactiver   javascript|les cookies|les scripts|cookies
javascript|le javascript   est|doit etre   desactive|necessaire|requis|active|bloque
les cookies|les scripts   sont|doivent etre   desactives|bloques|necessaires|actives
votre navigateur   n'est pas|n'est plus|ne prend pas|ne supporte pas|est obsolete|n'accepte pas
veuillez |merci de |   mettez a jour|mettre a jour   votre navigateur
veuillez |   confirmez|confirmer|verifiez   que vous   n'etes pas|etes
veuillez   vous reconnecter|vous connecter|vous identifier|recharger|reessayer
connectez-vous   pour|a nouveau
votre   session|connexion|requete   a expire|est expiree|a ete bloquee|a ete interrompue
nous ne   trouvons|pouvons   pas   cette page|la page|trouver cette page|trouver la page|afficher cette page|ce contenu
por favor, |por favor |debe |   active|activa|activar|habilite|habilita|habilitar|permita|acepte   javascript|las cookies|los scripts|cookies
javascript   esta|debe estar   desactivado|deshabilitado|activado|habilitado
las cookies|los scripts   estan   desactivadas|desactivados|bloqueadas|bloqueados
su navegador|tu navegador   no|esta desactualizado|es demasiado antiguo
por favor, |   actualice|actualiza   su navegador|tu navegador
por favor, |   confirme|verifique   que   no es un robot|es humano|es una persona
por favor, |   inicie sesion|inicia sesion|vuelva a iniciar sesion|identifiquese
su sesion|la sesion|tu sesion   ha caducado|ha expirado|caduco|ha terminado
su   solicitud|acceso   ha sido   bloqueada|bloqueado|rechazada|denegado
no   hemos podido|podemos   encontrar|cargar|mostrar   esta pagina|la pagina|este contenido
ha ocurrido|se ha producido|se produjo|ocurrio   un   error|problema
"""
#: Messages must be a sentence of their own, or go on with words to the reader or with another message.
MESSAGES = """
the |this |the requested |   page|article|story|document|file|content|url|site|quote page|resource   not found|cannot be found|could not be found|can't be found|does not exist|doesn't exist|no longer exists|is no longer available|is not available|has been removed|has been retired|has moved|may have moved|has expired|could not be loaded|cannot be loaded|cannot be displayed|cannot be shown|was not found
the   page|article|story|document|file|content   you requested|you are looking for|you were after|you asked for   cannot be found|could not be found|does not exist|has been removed|has moved|may have moved|has been retired|is no longer available|was not found|is gone
we're sorry, |we are sorry, |sorry,    this|the   page|quote page|article|story   has been retired|has been removed|could not be found|is no longer available
nothing   here|to see here|was found
the link|this link   may be|is|might be   broken|old|mistyped|invalid|dead|outdated
internal server|unexpected|fatal   error
error   while|on   loading|line
an error|an unexpected error|an internal error   occurred|has occurred|was encountered
something   went   wrong
service|service temporarily|site temporarily|temporarily   unavailable
bad   gateway|request
gateway|request|connection|server   timeout|time-out|timed out
connection   refused|reset|lost|failed
the upstream server|the server|the origin server   did not answer|did not respond|met an|encountered an|is not responding|refused the|returned an|timed out
back-end fetch   failed
the service|the site|this site|our site|we|this service|the website|this page   is|are   down for|under|undergoing|in   scheduled |planned |   maintenance
down for|under|scheduled|undergoing   maintenance
we'll be|we will be|be right   back   soon|shortly|
too many   requests
rate limit   exceeded|reached
access|permission   denied|forbidden|refused
session   expired|timed out|has expired|closed
unhandled|uncaught   exception|error|typeerror|referenceerror
traceback|stack trace
try again   later|in a|soon
unsupported|outdated   browser
one more   step
security   check
allow cookies   and   try again|reload
disable the blocker   and   reload|press reload|try again
seite|artikel|datei|inhalt   nicht   gefunden|verfugbar
die |diese |die angeforderte |die gesuchte   seite|datei   existiert nicht|wurde nicht gefunden|ist nicht verfugbar|konnte nicht|gibt es nicht|nicht gefunden
dienst|service|server|seite   vorubergehend |derzeit |zurzeit |   nicht   verfugbar|erreichbar
zugriff|zugang   verweigert|gesperrt
sitzung   abgelaufen|beendet
interner   serverfehler|fehler
ein|es ist ein   interner |unerwarteter |   fehler   aufgetreten|ist aufgetreten
etwas ist   schiefgelaufen|schief gegangen
zu viele   anfragen
wartungsarbeiten
page   introuvable|non trouvee|inexistante
cette page|la page|la page demandee|cet article   n'existe pas|n'existe plus|est introuvable|n'est pas disponible|n'est plus disponible|a ete supprimee|a ete supprime
service   momentanement |temporairement |   indisponible
acces   refuse|interdit
session   expiree|terminee
une erreur   est survenue|s'est produite|inattendue|interne
erreur   interne|serveur|du serveur
trop de   requetes
site en   maintenance
pagina   no   encontrada|disponible
la pagina|esta pagina|la pagina solicitada|este articulo   no existe|ya no existe|no esta disponible|ha sido eliminada|no se encuentra|ya no esta disponible
servicio   temporalmente |   no disponible
acceso   denegado|prohibido
sesion   caducada|expirada|cerrada
error   interno|del servidor
algo   salio mal|ha salido mal|fue mal
demasiadas   solicitudes|peticiones
sitio en   mantenimiento
just   a test|testing
placeholder|sample|dummy|filler|mock   text|copy|headline|content|article|paragraph
insert|add|enter   text|title|headline|copy|content|caption|name   here
your   text|title|headline|copy|content|summary|article summary   here|goes here|will appear here
test   post|article|page
asdf|qwer|qwerty   asdf|qwer|jkl|qwerty|zxcv
blah   blah
foo   bar baz
xxx   xxx
blindtext|platzhaltertext|mustertext|beispieltext
hier steht   ihr text|der text|ein blindtext
texte   provisoire|factice|de remplissage|d'exemple
faux   texte
votre|su   texte ici|texto aqui
texto   de relleno|provisional|de ejemplo|simulado
"""
#: Openings of filler and of notes left by editors, whatever follows.
OPENINGS = """
this is|here is|just   placeholder text|sample text|dummy text|filler text|a test post
headline|body copy|copy|text|title|caption|content|body|body text|subtitle|image|quote|summary   goes|comes   here
sample text|dummy text|placeholder text   for|to
text text   text
lorem   ipsum
dolor   sit amet
consectetur   adipiscing
todo: |tbd: |fixme: |tk: |to do: 
"""
#: Single words are messages only as whole sentences.
WORDS_ALONE = """
not found|forbidden|unauthorized|unauthorised|scheduled maintenance|under maintenance|gone|nicht gefunden|verboten|introuvable|interdit|prohibido
"""
#: They stand beside the others and count for coverage only.
WEAK_PHRASES = """
see   help page
request   id
reference   #
error   code
go back|return|back   to   the front page|markets|the home page|home
browse   other headlines
try   a search
switch them on   in your settings
this takes   about
please   retry in|reload|reload the page|wait
reload|refresh   this page|the page
contact   the help desk|support
oops
versuchen sie   es
bitte   prufen sie
zuruck   zur startseite
reessayez   dans
verifiez   l'adresse
retour   a l'accueil
intentelo   de nuevo
revise   la direccion
volver   a la portada
"""
#: Words of the usual filler Latin.
LATIN = set("""
lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi
aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui
officia deserunt mollit anim id est laborum
""".split())
#: Function words of the four languages; a sentence of filler has none.
FUNCTION_WORDS = set("""
the of and to in for on with at by from as is are was were be been it its this that which who has have had will would not no or but after before up down over under into about their our your
you we he she they his her us if than then there here all any more most some such only also one two der die das und ist nicht mit von zu im den dem des ein eine einen auf fur sich als bei nach
aus wie wird werden um bis hat sie ihr ihre wir er es oder le la les un une des du de et est pas pour dans sur avec par qui que au aux ce cette ces son sa ses vous nous il elle ont sont plus
el los las una y en con por para que del al su sus se lo como mas esta este ha han son
""".split())
_LATIN_END = re.compile(r"(?:us|um|is|it|at|or|ur|am|em|en|ens|ec|ae|im|in|ris|ate|ora|tur|ant|unt|os|a|o|i|e)$")

_MISSING = r"(?:undefined|null|NaN|None|nil|N/A_[A-Z_]+|\[object Object\])"
#: Fields in the notations of template engines, placeholders as people leave them, and marks of missing values where a template put them.
FIELDS = re.compile(
    "|".join([
        r"\{\{[^{}\n]{1,120}\}\}", r"\{%[^%\n]{1,120}%\}", r"<%[^%\n]{1,120}%>", r"[$#]\{[^{}\n]{1,60}\}", r"\{[A-Za-z]+(?:[_.][A-Za-z0-9]+)+\}", r"\{[A-Za-z]{3,30}\}", r"\{\d{1,2}\}",
        r"%\([A-Za-z_]\w*\)[sdif]", r"%%[A-Z][A-Z_]+%%", r"%[A-Z]+(?:_[A-Z]+)+%", r"\$[A-Z]+(?:_[A-Z]+)*\$", r"(?<!\w)__[A-Z][A-Z_]*__(?!\w)", r"@@[A-Z][A-Z_]*@@", r"<<[A-Za-z][A-Za-z_ ]*>>",
        r"\[\[[A-Za-z_. ]+\]\]", r"(?:&lt;|<)(?i:insert|your|enter|add) [^<>&\n]{1,60}(?:&gt;|>)", r"\[(?i:insert|enter|add|your)\b[^\[\]\n]{0,60}\]",
        r"\[(?i:(?:company|firm|analyst|ceo|first|last|author|city|product|ticker|client|customer)[ _]?name|name|date|amount|quote|figure|ticker|title|headline|byline|author|price|percent|number|tk|tbd|tbc|todo|to come|placeholder|x{2,}|[^\[\]\n]{1,40} (?:to confirm|to come|goes here|here)|to be (?:confirmed|added|determined)[^\[\]\n]{0,20})\]",
        r"\$\[XX+\]", r"\bXX+\.X+%?", r"_{3,}", r"\bTK TK\b", r"\[object Object\]", r"\bN/A_[A-Z]+\b", r"(?<![\w\"“'])NaN(?![\w\"”'])",
        rf"\bShares of {_MISSING} ", rf"(?:closed at|last price|, change|\bUpdated|\bBy|\bby) {_MISSING}(?![\w\"”'])", rf"(?m:^{_MISSING}(?=[:|,]))", rf"(?<=[.!?] ){_MISSING}:",
    ])
)
_MARKS = re.compile(r"[{\[<_@]|XX|%[A-Z(%]|\$[A-Z]|undefined|null|NaN|None|nil|N/A|TK TK|&lt;")
#: What follows the number of an error page.
CODES = re.compile(
    r"[45]\d\d ?[-:]? ?(?:not found|forbidden|nothing here|page not found|the page cannot|bad gateway|service unavailable|gateway time|internal server|too many"
    r"|unauthori[sz]ed|bad request|seite nicht|die angeforderte|page introuvable|cette page|pagina no|la pagina)"
)
#: What must follow a phrase that is too short by itself, from its start on.
TAILS = {
    "error ": re.compile(r"error (?:code )?\d{3,6}(?=[.\n]|$)"),
    "internal error ": re.compile(r"internal error \d{2,6}(?=[.\n]|$)"),
    "session ": re.compile(r"session \d{2,6} timed out"),
    "warning: ": re.compile(r"warning: [^.\n]{3,80} in /[\w/.]+ on line \d+"),
    "interactive chart ": re.compile(r"interactive chart (?:\d+ )?cannot be shown"),
}
_LETTERS_ONLY = re.compile(r"(?:[.!?\n] ?|\A)([a-z]+(?:,? [a-z]+)+)(?=[.!?\n]|\Z)")
_BEGINS = set("\n.!?:|>-–—*•…;)")


NOTICE, MESSAGE, ALONE, WEAK = 3, 2, 1, 0
#: What a sentence has that goes on from a message to the reader: the reader, the page itself, what to do, or a reference.
_TO_READER = re.compile(
    r"\b(?:you|your|our|us|please|retry|reload|refresh|this (?:page|site|content|resource|article|story|service)|try again|for now|later|ref|reference|request id|ray|code|client"
    r"|sie|ihr|ihre|ihrem|ihren|bitte|vous|votre|veuillez|nous|su|sus|usted|por ahora|por favor|mas tarde|plus tard|spater)\b"
)
_ENDS = re.compile(r" ?(?:[.!?:|,;)\n]|$| ?[-–—|] | ?(?:\d+|#\d+|[a-z]*\d[a-z\d]*)(?:[.\n]|$))")
_WHOLE = re.compile(r" ?(?:[.!?|\n]|$)")


def _phrases(rows: str) -> Iterator[str]:
    """Each choice of one alternative of each part; parts are set off by three blanks, alternatives by bars, and an alternative may be empty or end in a blank."""
    for row in rows.strip("\n").split("\n"):
        parts = [p.split("|") for p in row.split("   ")]
        for choice in product(*parts):
            phrase = " ".join(" ".join(x.strip() for x in choice).split())
            yield phrase + (" " if row.rstrip("\n").endswith(": ") else "")


@cache
def _automaton() -> ahocorasick.Automaton:
    known: dict[str, tuple[int, str | None]] = {}
    for kind, rows in ((WEAK, WEAK_PHRASES), (MESSAGE, MESSAGES), (NOTICE, NOTICES), (NOTICE, OPENINGS), (ALONE, WORDS_ALONE)):
        for phrase in _phrases(rows):
            if phrase:
                known[phrase] = (kind, None)
    for phrase in TAILS:
        known[phrase] = (NOTICE, phrase)
    a = ahocorasick.Automaton()
    for phrase, (kind, tail) in known.items():
        a.add_word(phrase, (len(phrase), kind, tail))
    a.make_automaton()
    return a


def fold(text: str) -> str:
    """Lower case, without accents, with single blanks; line breaks stay."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).replace("’", "'")
    return "\n".join([x for x in [" ".join(line.split()) for line in text.lower().split("\n")] if x])


def _latin(folded: str) -> Iterator[tuple[int, int]]:
    """Sentences of nothing but letters that are filler Latin."""
    for m in _LETTERS_ONLY.finditer(folded):
        w = m.group(1).replace(",", "").split(" ")
        run = best = 0
        for x in w:
            run = run + 1 if x in LATIN else 0
            best = max(best, run)
        if best >= 4 or best == len(w) >= 2:
            yield m.span(1)
        elif len(w) >= 5 and FUNCTION_WORDS.isdisjoint(w) and sum(bool(_LATIN_END.search(x)) for x in w) >= 0.8 * len(w):
            yield m.span(1)


def _leads(folded: str, start: int) -> bool:
    """Whether a sentence, line or the message after an error's number begins here."""
    before = folded[max(0, start - 24) : start].rstrip(" ")
    if not before or before[-1] in _BEGINS:
        return True
    return before[-1].isdigit() and bool(re.search(r"(?:^|[\n.!?|:]) ?(?:oops[.!]? )?(?:(?:http|error|erreur|fehler) )?[45]\d\d$", before))


def residue(text: str | None) -> tuple[bool, float]:
    """Whether the text has residue of its own, and the share of it that all matches cover."""
    if not text or not text.strip():
        return False, 0.0
    spans: list[tuple[int, int]] = []
    strong = False
    folded = fold(text)
    hits = [(end - size + 1, end + 1, kind, tail) for end, (size, kind, tail) in _automaton().iter(folded) if not folded[end + 1 : end + 2].isalnum() or folded[end] in " :#"]
    # The longest phrase that starts at a place.
    longest = {start: (end, kind, tail) for start, end, kind, tail in sorted(hits)}
    strongs = sorted(start for start, (_, kind, _t) in longest.items() if kind in (NOTICE, MESSAGE))
    for start, (end, kind, tail) in longest.items():
        if not _leads(folded, start):
            continue
        if tail:
            m = TAILS[tail].match(folded, start)
            if m:
                spans.append(m.span())
                strong = True
            continue
        if kind == ALONE:
            own = bool(_WHOLE.match(folded, end))
        elif kind == MESSAGE and not _ENDS.match(folded, end):
            stop = re.compile(r"[.!?\n]|$").search(folded, end).start()
            own = bool(_TO_READER.search(folded, end, stop)) or any(end < x < stop for x in strongs)
        else:
            own = True
        if own:
            spans.append((start, end))
            strong |= kind != WEAK
    for m in CODES.finditer(folded):
        before = folded[max(0, m.start() - 16) : m.start()].rstrip(" ")
        if not before or before[-1] in _BEGINS or re.search(r"(?:^|[\n.!?|]) ?(?:oops[.!]? )?(?:http|error|erreur|fehler|status|code)$", before):
            spans.append(m.span())
            strong = True
    for span in _latin(folded):
        spans.append(span)
        strong = True
    if _MARKS.search(text):
        for m in FIELDS.finditer(text):
            spans.append(m.span())
            strong = True
    covered = at = 0
    for a, b in sorted(spans):
        covered += max(0, b - max(a, at))
        at = max(at, b)
    return strong, min(1.0, covered / max(1, len(folded)))


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        found = [(i, *residue(t)) for i, t in zip(f["doc_id"], f["text"])]
        yield pd.DataFrame([x for x in found if x[1] or x[2]], columns=["doc_id", "strong", "coverage"])


def residue_coverage(documents: DataFrame) -> DataFrame:
    """doc_id, strong, coverage of each document with any match."""
    texts = documents.select("doc_id", "text").where("text <> '' and doc_id is not null")
    return texts.mapInPandas(_scan, "doc_id long, strong boolean, coverage double").distinct()


def residue_documents(documents: DataFrame, least_coverage: float = 0.0) -> DataFrame:
    """doc_id of the documents with residue of their own that covers at least this share of the text."""
    return residue_coverage(documents).where(F.col("strong") & (F.col("coverage") >= least_coverage)).select("doc_id").distinct()


def without_residue(documents: DataFrame, least_coverage: float = 0.0) -> DataFrame:
    """The documents that are left when those with residue are excluded; null and empty texts stay."""
    return documents.join(residue_documents(documents, least_coverage), "doc_id", "left_anti")
