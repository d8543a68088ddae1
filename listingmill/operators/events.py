"""Kinds of broker mail, with the link, title, number and file that belong to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signing services, and the phrases that tell the kinds of mail apart.
SIGNING = ("adobesign.com", "echosign.com", "docusign.com", "docusign.net", "dropboxsign.com", "hellosign.com", "signnow.com")
SIGNING_LINK = r"(?i)(https?://[^\s<>\"']+(?:documents\.adobe|adobesign|echosign|dropboxsign|hellosign|docusign)[^\s<>\"']*)"
ANY_LINK = r"(?i)(https?://[^\s<>\"']+)"
NDA = r"(?i)\bnda\b"
ASKED = r"(?i)signature requested|requests your signature"
CIM_FILE, NDA_FILE = r"(?i)\bcim\b|offering.?memo|memorandum|\bom\b", r"(?i)\bnda\b|non.?disclosure"
CIM_TEXT = r"(?i)attached is our cim|attached.{0,20}\bcim\b"
SENT = r"(?i)sent (?:an )?nda|dropbox sign|please sign"
INTEREST = r"(?i)click here to (?:sign|complete).{0,12}nda"
ROOM = r"(?i)sharefile|virtual data room|has shared the folder|granted access"
DOCUMENT = r"(?i)\.(?:pdf|doc|docx)$"
DISCOVERY_TYPES, NOISE_TYPES, DISCOVERY_SUBJECT = ("daily_digest", "single_listing"), ("newsletter_marketing", "account_notice"), "new business opportunities"
READ = 8000


def is_discovery(format_id: Column, email_type: Column, status: Column, subject: Column, sender: Column, formats: tuple[str, ...] = (), keep: tuple[str, ...] = (), market: str = "") -> Column:
    """Whether mail announces listings and is no answer of a broker.

    It is if its format is one of ``formats`` or of a discovery type, if its format is a control one of a noise type (but for
    those in ``keep``), by its subject, or if it is an alert of the ``market``.
    """
    false = F.lit(False)
    known = F.coalesce(format_id.isin(*formats), false) if formats else false
    typed = F.coalesce(email_type.isin(*DISCOVERY_TYPES), false)
    noise = F.coalesce((status == "control") & email_type.isin(*NOISE_TYPES), false) & ~(F.coalesce(format_id.isin(*keep), false) if keep else false)
    s = F.lower(F.coalesce(subject, F.lit("")))
    alert = (F.contains(F.lower(F.coalesce(sender, F.lit(""))), F.lit(market.lower())) & F.contains(s, F.lit("alert"))) if market else false
    return known | typed | noise | F.contains(s, F.lit(DISCOVERY_SUBJECT)) | alert


def classify(subject: Column, sender: Column, body: Column, files: Column, market: str = "", network: str = "", read: int | None = READ) -> Column:
    """kind, link, cue, number and file of a mail; kind is null for none. The first of nine rules that holds decides.

    ``files`` is an array of names. ``read`` limits how much of a body is looked at, as the rules
    were made for; None reads all of it. ``market`` and ``network`` name two providers whose own wording
    counts ("interest from ...", new messages of their domain).
    """
    subj, whole = F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))
    text = F.substring(whole, 1, read) if read else whole
    both = F.concat_ws("\n", subj, text)
    domain = F.lower(F.regexp_extract(F.coalesce(sender, F.lit("")), r"@([^\s>@]+)>?\s*$", 1))
    names = F.filter(F.coalesce(files, F.array().cast("array<string>")), lambda f: f.rlike(DOCUMENT))
    nothing = F.lit(None).cast("string")

    def decided(s: Column) -> Column:
        subj, text, both, domain, names = (s[k] for k in ("subj", "text", "both", "domain", "names"))
        links, signing = F.regexp_extract_all(text, F.lit(ANY_LINK), 1), F.regexp_extract_all(text, F.lit(SIGNING_LINK), 1)
        first = lambda c: F.get(c, F.lit(0))
        likely = F.filter(links, lambda u: u.rlike(r"(?i)adobe|sign"))
        cims, ndas = F.filter(names, lambda f: f.rlike(CIM_FILE)), F.filter(names, lambda f: f.rlike(NDA_FILE))
        cue = lambda front, back="": F.trim(F.regexp_replace(F.regexp_replace(subj, front, ""), back, "") if back else F.regexp_replace(subj, front, ""), F.lit(" \"'"))
        number = F.nullif(F.regexp_extract(both, r"(?i)\bdeal\s*#?\s*(\d{5,})", 1), F.lit(""))
        is_nda = both.rlike(NDA)
        by_service = domain.rlike("(?:" + "|".join(d.replace(".", r"\.") for d in SIGNING) + ")$")
        wanted = both.rlike(INTEREST) | (both.rlike(rf"(?i)interest from {market}") if market else F.lit(False))
        nda_like = F.filter(links, lambda u: u.rlike(r"(?i)nda|sign|baton" + (f"|{market}" if market else "")))
        out = lambda kind, link=nothing, c=subj, n=nothing, f=nothing: F.struct(F.lit(kind).alias("kind"), link.alias("link"), c.alias("cue"), n.alias("number"), f.alias("file"))
        cim_cue = cue(r"(?i)^(?:\w+,?\s*)?attached is our cim for\s*", r"(?i)\s*for your review\.?$")
        return (
            F.when(subj.rlike(r"(?i)you signed") & subj.rlike(NDA), out("nda_signed", c=cue(r"(?i)^you signed:\s*[\"']?")))
            .when((by_service | both.rlike(ASKED)) & is_nda, out("nda_available", F.coalesce(first(signing), first(likely)), cue(r"(?i)^signature requested on\s*[\"']?")))
            .when((F.size(cims) > 0) | both.rlike(CIM_TEXT), out("cim_received", c=F.when(cim_cue == "", subj).otherwise(cim_cue), f=F.coalesce(first(cims), first(names))))
            .when((F.size(ndas) > 0) & is_nda, out("nda_available", n=number))
            .when(both.rlike(SENT), out("nda_available", first(signing), cue(r"(?i)^sent nda:\s*"), number))
            .when(wanted, out("nda_available", F.coalesce(first(nda_like), first(links))))
            .when(both.rlike(ROOM), out("vdr_access", first(links)))
            .when((F.contains(domain, F.lit(network)) if network else F.lit(False)) & both.rlike("(?i)new message"), out("broker_message"))
        )

    return F.transform(F.array(F.struct(subj.alias("subj"), text.alias("text"), both.alias("both"), domain.alias("domain"), names.alias("names"))), decided)[0]
