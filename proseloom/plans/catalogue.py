"""The rule catalogue: declarative rows that the compiler turns into columns."""

from __future__ import annotations

from dataclasses import dataclass

#: Bands of a probability where a rule gives none: from ``REVIEW`` on a finding is for review, from ``ACT`` on it acts.
REVIEW, ACT = 0.35, 0.7
STATUSES = ("active", "review-only", "draft")


@dataclass(frozen=True)
class Rule:
    """One row of the catalogue.

    ``pattern`` or ``phrases`` decides, with ``least`` matches, and ``absent`` vetoes.  A rule with ``asks``, the keys of
    the context that its question needs, asks a judge: of what its pattern found, or of every eligible unit if it has
    none.  A rule with ``check`` is decided by a column of its id; ``fix`` names what mends what its pattern flags.  ``question`` is the wording, which comes with rule files.  The other fields say which units are eligible:
    kind, path (``include`` and ``exclude`` globs), doc type, role, words, and whether code, generated files and files whose build makes its own quotes count.  ``code_only`` looks
    past strings and comments of source units.
    """

    id: str
    category: str
    pattern: str = ""
    flags: str = "gu"
    phrases: tuple[str, ...] = ()
    absent: str = ""
    least: int = 1
    code_only: bool = False
    check: bool = False
    asks: tuple[str, ...] | None = None
    kinds: tuple[str, ...] = ("paragraph",)
    include: tuple[str, ...] = ("**",)
    exclude: tuple[str, ...] = ()
    doc_types: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    min_words: int = 0
    not_in_code: bool = False
    not_generated: bool = False
    own_quotes: bool = True
    severity: str = "minor"
    status: str = "active"
    review: float = REVIEW
    act: float = ACT
    fix: str = ""
    question: str = ""

    @property
    def area(self) -> str:
        return self.id.split("-")[0]

    @property
    def tier(self) -> str:
        """mechanical: decided by its pattern; judged: by a question; both: its pattern nominates what the question decides."""
        searched = bool(self.pattern or self.phrases or self.check)
        return "mechanical" if self.asks is None else "both" if searched else "judged"

    @property
    def review_only(self) -> bool:
        """Rules under review, and raw searches of source, never act on their own."""
        return self.status == "review-only" or (self.tier == "mechanical" and "source" in self.kinds)

    @property
    def scope(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        return self.include, self.exclude


# Where units of a kind come from, and what no rule looks at.
_COMPONENTS, _MARKDOWN = ("**/*.tsx", "**/*.jsx"), ("**/*.md", "**/*.mdx")
INCLUDE_BY_KIND = {
    "paragraph": _MARKDOWN,
    "heading": _MARKDOWN,
    "jsx-text": _COMPONENTS,
    "attr-string": (*_COMPONENTS, "**/*.mdx"),
    "class-list": _COMPONENTS,
    "element": _COMPONENTS,
    "source": (),
    "file": (),
}
EXCLUDE_TESTS, EXCLUDE = ("**/*.test.*", "**/*.spec.*"), ("**/*.stories.*", "**/CHANGELOG.md")


def filed(id: str, category: str, pattern: str = "", flags: str = "gu", *, kinds: tuple[str, ...], include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), **more) -> Rule:
    """A rule with the scope of rule files: the files of its kinds if it names none, and without tests unless it is about them."""
    include = include or tuple(dict.fromkeys(g for kind in kinds for g in INCLUDE_BY_KIND[kind]))
    usual = EXCLUDE if any(x in g for g in include for x in (".test", ".spec", "{test,spec}", "__tests__")) else (*EXCLUDE_TESTS, *EXCLUDE)
    return Rule(id, category, pattern, flags, kinds=kinds, include=include, exclude=tuple(dict.fromkeys((*usual, *exclude))), **more)



_PROSE = ("tutorial", "howto", "reference", "explanation", "lesson", "marketing", "ui", "unknown")
_DOCS = ("tutorial", "howto", "reference", "explanation", "agent-instructions")
_SOURCE, _TEXT, _COPY, _LABELS = ("source",), ("paragraph", "jsx-text"), ("paragraph", "jsx-text", "attr-string"), ("jsx-text", "attr-string")
_HEADED, _SHOWN, _ALL = ("paragraph", "heading"), ("paragraph", "heading", "jsx-text"), ("paragraph", "heading", "jsx-text", "attr-string")
_TSX, _TYPED, _WORKFLOWS = ("**/*.tsx", "**/*.jsx"), ("**/*.ts", "**/*.tsx"), ("**/.github/workflows/*.{yml,yaml}",)
_SCRIPTS = ("**/*.{ts,tsx,js,jsx,mts,mjs,cts,cjs}",)
_TESTS = ("**/*.{test,spec}.{ts,tsx,js,jsx,mts,mjs,cts,cjs}", "**/__tests__/**/*.{ts,tsx,js,jsx,mts,mjs}")
_MADE = ("**/*.d.ts", "**/*.min.js", "**/*.gen.*", "**/*.generated.*", "**/generated/**", "**/__generated__/**", "**/vendor/**", "**/fixtures/**", "**/__fixtures__/**", "**/migrations/**")
_STYLE = {"status": "review-only", "review": 0.4, "act": 0.75}
_REVIEWED = {"status": "review-only"}

# Fixed values, to the end of the table: ids, patterns, phrases and conditions that decide findings, and so have to equal
# those that users already rely on.
RULES = (
    filed("authoring-approval-every-step", "instruction-quality", r"\b(?:permission|approval|confirm|ask)\b", "giu", asks=("docType", "headingAbove", "role", "element"), kinds=_COPY, doc_types=("skill", "agent-instructions"), not_in_code=True, **_REVIEWED),
    filed("authoring-fixed-agent-quota", "instruction-quality", r"\b(?:always|every task|minimum|at least|exactly)\b", "giu", asks=("docType", "headingAbove", "role", "element"), kinds=_COPY, doc_types=("skill", "agent-instructions"), not_in_code=True, **_REVIEWED),
    filed("authoring-generic-coding-advice", "instruction-quality", r"\b(?:clean code|best practices|meaningful names|descriptive (?:names|variable names)|handle errors properly)\b", "giu", asks=("docType", "headingAbove", "role", "element"), kinds=_COPY, doc_types=("skill", "agent-instructions"), not_in_code=True, **_REVIEWED),
    filed("authoring-generic-verification", "instruction-quality", r"\b(?:double.check|verify carefully|test thoroughly|ensure (?:quality|correctness))\b", "giu", asks=("docType", "headingAbove", "role", "element"), kinds=_COPY, doc_types=("skill", "agent-instructions", "plan"), not_in_code=True, **_REVIEWED),
    filed("authoring-plan-vague-acceptance", "instruction-quality", r"\b(?:works? (?:well|correctly)|user.friendly|production.ready|robust|seamless)\b", "giu", asks=("docType", "headingAbove", "role", "element"), kinds=_COPY, doc_types=("plan",), not_in_code=True, **_REVIEWED),
    filed("copywriting-anthropomorphism", "machine-prose", r"\b(?:the |this |our )?(?:system|app|application|api|server|service|tool|library|compiler|browser|database|program|script|function|model)s? (?:thinks?|wants?|knows?|tries|try|remembers?|decides?|believes?|feels?|likes?|hopes?|assumes?)\b", "giu", kinds=("paragraph",), doc_types=("tutorial", "howto", "reference", "explanation", "agent-instructions", "unknown"), not_in_code=True),
    filed("copywriting-antithesis-contrast", "machine-prose", r"[\p{L}\p{N}’'], not (?:a |an |the |another |just |only )?[\p{L}\p{N}’'-]+|(?:^|[.!?]\s+)Not (?:a|an|another|the|just|only|one) [\p{L}\p{N}’'-]+", asks=("docType", "element"), kinds=_SHOWN, not_in_code=True, **_STYLE),
    filed("copywriting-antithesis-frame", "machine-prose", r"""(?<!["“‘'])\bnot (?:just|only|merely) (?:a |an |the |about )?[\w-]+(?: [\w-]+){0,4}(?:[,;]? but|[,;] (?:it|they|we|this)(?:['’](?:s|re)| is| are))\b|(?<!["“‘'])\b(?:it|this|that)(?:['’]s| is)(?: not|n['’]t) (?:just |only )?(?:about )?[^.!?,;]{1,40}[.,;] (?:it|this|that)(?:['’]s| is)\b""", "giu", kinds=_TEXT, not_in_code=True),
    filed("copywriting-artificial-balance", "machine-prose", asks=("docType",), kinds=_TEXT, min_words=5, not_in_code=True, **_STYLE),
    filed("copywriting-bare-confirm-label", "actionable-microcopy", "^(?:Confirm|OK|Okay|Yes|Submit|Proceed)[.!]?$", "giu", asks=("element", "section"), kinds=_LABELS, roles=("button", "aria", "label"), not_in_code=True, severity="major", **_REVIEWED),
    filed("copywriting-boilerplate-offer", "machine-prose", "let me know|feel free to|happy to help|hope this helps|if you have any (?:other |further )?questions|reach out if", "gui", asks=("docType",), kinds=_TEXT, **_STYLE),
    filed("copywriting-canned-phrasing", "machine-prose", phrases=("in today's fast-paced world", "in the ever-evolving landscape", "let's dive in", "let's delve", "at its core", "it is important to note", "it's worth noting", "when it comes to", "the truth is", "now more than ever", "stands as a testament", "at the end of the day", "one thing is clear", "the bottom line is", "game-changer", "in the realm of"), asks=("docType",), kinds=_TEXT, **_STYLE),
    filed("copywriting-claim-without-evidence", "evidence-over-claims", phrases=("powerful", "easy to use", "seamless", "intuitive", "robust", "best-in-class", "industry-leading", "world-class", "innovative", "cutting-edge", "beautiful", "simple", "fast", "flexible", "modern", "smart", "next-generation", "enterprise-grade", "blazing", "faster", "fastest", "simpler", "easier", "smarter", "trusted by", "loved by"), asks=("headingAbove", "docType"), kinds=_SHOWN, not_in_code=True, **_REVIEWED),
    filed("copywriting-click-here-links", "actionable-cta", "^(?:click here|here|learn more|read more|more|link|this link|this page|see more|details)[.!]?$", "giu", kinds=("jsx-text",), roles=("link",), not_in_code=True),
    filed("copywriting-conditions-first", "page-structure", r"\b(?:if|unless|only when)\b", "giu", asks=("docType", "headingAbove"), kinds=("paragraph",), doc_types=_DOCS, not_in_code=True, **_REVIEWED),
    filed("copywriting-confirmshaming", "actionable-microcopy", r"\b(?:no thanks|no,? i|i (?:do not|don.t) want)\b", "giu", asks=("docType", "headingAbove", "role", "element"), kinds=_COPY, doc_types=("ui",), not_in_code=True, **_REVIEWED),
    filed("copywriting-copula-avoidance", "machine-prose", r"""(?<!["“‘'])\b(?:serves|stands) as (?:a|an|the)\b|(?<!["“‘'])\bboasts\b""", "giu", kinds=_TEXT, not_in_code=True, **_REVIEWED),
    filed("copywriting-cta-names-outcome", "actionable-cta", phrases=("submit", "click here", "click", "proceed", "go", "next", "learn more", "read more", "ok", "okay", "done", "finish", "more info", "see more"), asks=("element",), kinds=_LABELS, roles=("button", "link", "aria", "label"), not_in_code=True, **_REVIEWED),
    filed("copywriting-dead-link", "page-structure", "href=[\"']#[\"']", kinds=_SOURCE, include=_TSX, exclude=("**/examples/**", "**/registry/**", "**/*demo*"), severity="major", **_REVIEWED),
    filed("copywriting-dead-weight-hedges", "machine-prose", phrases=("we believe that", "it is important to note that", "it's worth noting that", "it goes without saying", "whether you're a", "our mission is to", "we are committed to", "designed to be", "powerful yet simple", "at its core", "in order to", "please note that", "needless to say", "as you may know"), asks=(), kinds=_TEXT, doc_types=_PROSE, not_in_code=True, **_REVIEWED),
    filed("copywriting-em-dash-in-ui", "machine-prose", r"[ \u00a0]\u2014|\u2014[ \u00a0]", kinds=_LABELS, doc_types=("ui", "unknown"), not_in_code=True, **_REVIEWED),
    filed("copywriting-emoji-in-ui", "actionable-microcopy", r"\p{Extended_Pictographic}", kinds=_LABELS, doc_types=("ui", "unknown"), not_in_code=True),
    filed("copywriting-empty-state-no-action", "actionable-microcopy", r"\b(?:no|nothing|empty)\b", "giu", asks=("element", "section"), kinds=_LABELS, doc_types=("ui", "unknown", "lesson"), not_in_code=True, **_REVIEWED),
    filed("copywriting-error-descriptions", "reference-reading", r"\b(?:error|HTTP)\s+[45][0-9]{2}\b|\b(?:forbidden|too many requests|unauthorized)\b", "giu", asks=("docType", "headingAbove"), kinds=("paragraph",), doc_types=_DOCS, roles=("body", "list-item"), not_in_code=True, **_REVIEWED),
    filed("copywriting-excessive-hedging", "machine-prose", phrases=("might", "could", "perhaps", "generally", "arguably", "potentially", "somewhat", "may", "possibly", "in some cases"), least=3, asks=("docType",), kinds=_TEXT, **_STYLE),
    filed("copywriting-external-arrow-internal-link", "page-structure", r"""<(?:(?:a|Link)\b(?![^>]*target="_blank")(?:=>|[^>])*\bhref="(?:#|/(?!/))[^"]*"|button\b)(?:=>|[^>])*>(?:(?!</(?:a|Link|button)>)[\s\S]){0,300}?(?:↗|&#8599;|&nearr;|ArrowUpRight|ExternalLink)""", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("copywriting-fabricated-specificity", "evidence-over-claims", asks=("docType", "brief"), kinds=_TEXT, min_words=5, not_in_code=True, **_STYLE),
    filed("copywriting-filler-words", "machine-prose", phrases=("very", "really", "just", "basically", "actually", "simply", "quite", "rather", "somewhat", "extremely", "incredibly", "truly"), least=2, asks=(), kinds=_TEXT, doc_types=_PROSE, not_in_code=True, **_REVIEWED),
    filed("copywriting-flat-description", "reader-first-framing", "(?:^|[.!?] )(?:It|This|The) [^.!?]{20,120} is [^.!?]{6,}[.!?]", asks=("docType", "headingAbove"), kinds=_TEXT, doc_types=("marketing", "ui", "unknown", "lesson"), not_in_code=True, **_STYLE),
    filed("copywriting-friction-cta", "actionable-cta", phrases=("contact us", "talk to sales", "request a demo", "sign up", "create an account", "get started", "subscribe", "buy now", "purchase", "book a call", "schedule a call"), asks=("role", "docType"), kinds=("jsx-text", "heading", "paragraph"), roles=("button", "link", "heading", "body", "unknown"), not_in_code=True, **_STYLE),
    filed("copywriting-generic-audience", "evidence-over-claims", phrases=("teams of all sizes", "be more productive", "save time and money", "grow your business", "take it to the next level", "all-in-one", "everything you need", "and much more", "and more", "anyone who", "helps you", "tools you need", "better results", "improve your workflow", "for everyone", "of all kinds"), asks=("docType",), kinds=_SHOWN, not_in_code=True, **_REVIEWED),
    filed("copywriting-generic-framing", "reader-first-framing", asks=("docType",), kinds=_TEXT, min_words=5, not_in_code=True, **_STYLE),
    filed("copywriting-generic-language", "machine-prose", asks=("docType",), kinds=_TEXT, min_words=5, not_in_code=True, **_STYLE),
    filed("copywriting-generic-validation", "machine-prose", phrases=("great question", "excellent point", "absolutely", "certainly", "fantastic", "wonderful", "amazing", "you are absolutely right", "great job"), asks=("docType",), kinds=_TEXT, **_STYLE),
    filed("copywriting-latinisms", "reader-first-framing", r"\b(?:e\.g\.|i\.e\.|etc\.|et al\.|viz\.|cf\.)", kinds=_HEADED, doc_types=("tutorial", "howto", "reference", "explanation", "agent-instructions", "lesson"), not_in_code=True, **_REVIEWED),
    filed("copywriting-leaked-error-message", "actionable-microcopy", r"\{(error|err|e)\.(message|stack)\}", asks=(), kinds=_SOURCE, include=_TYPED, severity="major", **_REVIEWED),
    filed("copywriting-live-region-feedback", "page-structure", r"""className="[^"]*\b(toast|snackbar|notification|banner)\b""", absent="aria-live|role=\"(status|alert)\"", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("copywriting-machine-prose", "machine-prose", phrases=("I'd be happy to", "happy to help", "let's dive in", "dive into", "delve", "in today's fast-paced", "in today's world", "experts believe", "studies show", "it's no secret", "game-changer", "game changer", "revolutionize", "revolutionise", "unlock the power", "elevate your", "take your", "to the next level", "in conclusion", "as an AI", "seamlessly integrate", "robust and scalable", "whether you're", "look no further", "the landscape of", "navigate the", "tapestry", "testament to", "it's important to remember", "here is some", "here's some", "here are some"), asks=(), kinds=_TEXT, doc_types=_PROSE, not_in_code=True, **_REVIEWED),
    filed("copywriting-mechanism-over-outcome", "reader-first-framing", asks=("docType",), kinds=_TEXT, min_words=5, not_in_code=True, **_STYLE),
    filed("copywriting-meta-commentary", "machine-prose", phrases=("in this section", "as mentioned above", "as we will see", "let me break this down", "to put it simply", "in other words", "the takeaway here", "this section covers", "as discussed", "let us take a step back"), least=2, asks=("docType",), kinds=_TEXT, **_STYLE),
    filed("copywriting-missing-reasoning-link", "evidence-over-claims", asks=("docType",), kinds=_TEXT, min_words=5, not_in_code=True, **_STYLE),
    filed("copywriting-nominalisations", "reader-first-framing", phrases=("make a decision", "perform an analysis", "conduct an analysis", "conduct a review", "perform a review", "provide assistance", "give consideration to", "reach a conclusion", "come to a conclusion", "make an assessment", "carry out an evaluation", "perform an evaluation", "make a selection", "provide a description of", "make an adjustment", "perform a validation", "make a recommendation", "give an explanation"), kinds=_TEXT, doc_types=_PROSE, not_in_code=True),
    filed("copywriting-over-explanation", "machine-prose", asks=("docType",), kinds=_TEXT, min_words=5, not_in_code=True, **_STYLE),
    filed("copywriting-participle-tail", "machine-prose", r"""(?<!["“‘']),\s+(?:ensuring|highlighting|underscoring|showcasing|emphasi[sz]ing|reinforcing|cementing|solidifying|fostering|signall?ing)\b""", "giu", kinds=_TEXT, not_in_code=True),
    filed("copywriting-passive-voice", "machine-prose", r"\b(?:is|are|was|were|be|been|being|gets?|got)\s+(?:\w+ly\s+)?\w+(?:ed|en|wn)\b(?:\s+by\b)?", "giu", asks=("docType",), kinds=_HEADED, doc_types=("tutorial", "howto", "reference", "explanation", "agent-instructions", "lesson", "unknown"), not_in_code=True, **_STYLE),
    filed("copywriting-permission-benefit", "actionable-microcopy", r"\b(?:allow notifications|grant .*permission|requires? .*access)\b", "giu", asks=("docType", "headingAbove", "role", "element"), kinds=_COPY, doc_types=("ui",), not_in_code=True, **_REVIEWED),
    filed("copywriting-promotional-docs-voice", "evidence-over-claims", phrases=("simply", "easy", "easily", "blazing", "blazing-fast", "powerful", "seamless", "seamlessly", "effortless", "effortlessly", "robust", "best-in-class", "world-class", "cutting-edge", "state-of-the-art", "supercharge", "unlock"), asks=("docType",), kinds=_HEADED, doc_types=_DOCS, not_in_code=True, **_REVIEWED),
    filed("copywriting-prompt-restatement", "machine-prose", asks=("docType",), kinds=_TEXT, min_words=5, not_in_code=True, **_STYLE),
    filed("copywriting-punctuation-tics", "machine-prose", asks=("docType",), kinds=_TEXT, min_words=5, not_in_code=True, **_STYLE),
    filed("copywriting-reader-first", "reader-first-framing", phrases=("platform", "software", "solution", "suite", "all-in-one", "introducing", "meet", "is a", "is the", "is an", "we built", "we made", "the tool", "a tool", "now with", "now available"), asks=("docType", "headingAbove"), kinds=("heading", "jsx-text"), doc_types=("marketing", "ui", "unknown", "lesson"), roles=("heading",), not_in_code=True, **_STYLE),
    filed("copywriting-register-shift", "machine-prose", phrases=("we are pleased to", "we're stoked", "furthermore", "moreover", "gonna", "ain't", "henceforth", "thus", "utilize", "utilise", "herein", "aforementioned", "kindly", "per our", "whilst"), asks=(), kinds=_SHOWN, doc_types=_PROSE, not_in_code=True, **_REVIEWED),
    filed("copywriting-repetitive-transitions", "machine-prose", phrases=("moreover", "furthermore", "additionally", "consequently", "thus", "hence", "in addition", "in conclusion", "to summarize", "ultimately"), least=2, asks=("docType",), kinds=_TEXT, **_STYLE),
    filed("copywriting-requirements-language", "reader-first-framing", r"\bshould\b", "giu", asks=("docType", "headingAbove"), kinds=("paragraph",), doc_types=_DOCS, not_in_code=True, **_REVIEWED),
    filed("copywriting-searchable-headings", "page-structure", r"^(?:common (?:issues|problems)|more (?:info(?:rmation)?|details)|overview|miscellaneous|other)\s*[.:?]?$", "giu", asks=("docType", "headingAbove"), kinds=("heading",), doc_types=_DOCS, not_in_code=True, **_REVIEWED),
    filed("copywriting-semantic-links", "page-structure", r"<(div|span|li)\b[^>]*\bonClick=\{[^}]*(router\.push|navigate\(|location\.href)", "gus", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("copywriting-slogan-headings", "machine-prose", r"<h[1-3]\b[^>]*>(?:\s|<br\s*/>|<span[^>]*>|</span>)*[A-Z$\d][\w’'$,-]*(?:[ \t]+[\w’'$,-]+){0,3}[.!?](?:\s|<br\s*/>|<span[^>]*>|</span>)+[A-Z$\d][\w’'$,-]*(?:[ \t]+[\w’'$,-]+){0,3}[.!?]", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("copywriting-structural-symmetry", "machine-prose", asks=("docType",), kinds=_TEXT, min_words=5, not_in_code=True, **_STYLE),
    filed("copywriting-success-state-specific", "actionable-microcopy", "^(?:success[!.]?|operation completed(?: successfully)?[!.]?|done[!.]?)$", "giu", asks=("docType", "headingAbove", "role", "element"), kinds=_COPY, doc_types=("ui",), not_in_code=True, **_REVIEWED),
    filed("copywriting-tee-up", "machine-prose", r"""(?<!["“‘'])\bhere['’]s the (?:thing|kicker|catch|deal|twist)\b|(?<!["“‘'])\bthe (?:kicker|catch|twist)\?|(?<!["“‘'])\bwhat struck me (?:was|is)\b|(?<!["“‘'])\blet that sink in\b|(?<!["“‘'])\bhere['’]s (?:a quick way to|the short version)\b|(?<!["“‘'])\bthe part worth knowing\b|(?<!["“‘'])\bthat['’]s the whole (?:pitch|idea|point|story)\b""", "giu", kinds=_TEXT, not_in_code=True),
    filed("copywriting-temporal-words", "reference-reading", phrases=("currently", "recently", "at the moment", "coming soon", "in the near future", "as of today", "latest version", "the new", "brand new", "this year", "last year", "next release", "soon"), asks=("docType",), kinds=_HEADED, doc_types=_DOCS, not_in_code=True, **_STYLE),
    filed("copywriting-toast-successfully", "actionable-microcopy", r"\bsuccessfully\b", "giu", kinds=_LABELS, doc_types=("ui", "unknown"), not_in_code=True),
    filed("copywriting-unexplained-action", "reader-first-framing", asks=("docType",), kinds=_TEXT, min_words=5, not_in_code=True, **_STYLE),
    filed("copywriting-unnatural-polish", "machine-prose", asks=("docType",), kinds=("paragraph",), doc_types=("tutorial", "howto", "explanation", "agent-instructions", "lesson", "marketing", "unknown"), **_STYLE),
    filed("copywriting-unverifiable-proof", "evidence-over-claims", r"logoipsum|placehold\.|placeholder\.com|via\.placeholder|dummyimage|lorem ipsum", "gui", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("copywriting-vague-error", "actionable-microcopy", phrases=("error occurred", "an error has occurred", "something went wrong", "please try again", "try again", "try saving again", "try again later", "oops", "invalid", "unexpected error", "an error occurred", "failed"), asks=("element", "docType", "section"), kinds=_LABELS, doc_types=("ui", "unknown", "lesson"), not_in_code=True, severity="major", **_REVIEWED),
    filed("copywriting-visual-direction-instruction", "actionable-microcopy", r"\b(?:above|below|left|right)\b", "giu", asks=("docType", "headingAbove", "role", "element"), kinds=_COPY, doc_types=("ui",), not_in_code=True, **_REVIEWED),
    filed("craft-atmosphere-gradient", "generic-decoration", r"""\bbg-(?:gradient-to|linear-to|radial)-?[\w-]*[^"'`\n]*?\b(?:from|via|to)-(?:purple|violet|fuchsia|indigo|cyan)-\d{2,3}\b|\b(?:from|via)-(?:purple|violet|fuchsia|indigo|cyan)-\d{2,3}\b[^"'`\n]*?\bbg-(?:gradient-to|linear-to|radial)""", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("craft-decoration-no-role", "generic-decoration", r"""<(?:div|span)\b(?=[^>]*?(?:\babsolute\b|\bfixed\b))(?=[^>]*?(?:pointer-events-none|aria-hidden|["\s]-(?:inset|top|right|bottom|left)-(?:[2-9]|\d{2})\b))(?=[^>]*?(?:gradient|bg-linear|bg-radial|\bblur|backdrop-blur|mix-blend|opacity-|(?=[^>]*?\brounded-full\b)(?=[^>]*?\bborder\b)(?=[^>]*?\b(?:h|w|size)-(?:[2-9]\d|\d{3})\b)))(?![^>]*?(?:size-\[max\(100%|pointer-fine:hidden|bg-clip-text|\bmask-))[^>]*?/>""", "gus", asks=(), kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("craft-decorative-ordinals", "generic-decoration", r"""\b(?:number|num|step|index|idx|no|label|eyebrow)\s*:\s*["'`]0[1-9]\b|>\s*0[1-9]\s*[./)]?\s*<""", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("craft-default-indigo", "colour-system", r"\b(?:bg|text|border|ring|from|via|to|fill|stroke|outline|accent|shadow|decoration)-indigo-\d{2,3}\b", kinds=_SOURCE, include=("**/*.tsx", "**/*.jsx", "**/*.css"), **_REVIEWED),
    filed("craft-emoji-in-copy", "generic-decoration", r"""(?<![=-])>[^<{]*?(?:[A-Za-z][^<{]*?[\u{1F300}-\u{1FAFF}✨⚡✅❌⭐❤]|[\u{1F300}-\u{1FAFF}✨⚡✅❌⭐❤]️?\s*[A-Za-z])|\b(?:title|label|heading|description|subtitle|cta|text)\s*[:=]\s*\{?\s*["'`](?:[^"'`\n]*?[A-Za-z][^"'`\n]*?[\u{1F300}-\u{1FAFF}✨⚡✅❌⭐❤]|[\u{1F300}-\u{1FAFF}✨⚡✅❌⭐❤]️?\s*[A-Za-z])""", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("craft-faux-product-chrome", "generic-decoration", r"(?:<(?:span|div|i)\b(?=[^>]*\brounded-full\b)(?=[^>]*\b(?:size|h)-(?:1|1\.5|2|2\.5|3|3\.5)\b)[^>]*/>\s*){3}", kinds=_SOURCE, include=("**/*.tsx",), **_REVIEWED),
    filed("craft-hover-only-affordance", "resilience", r"(group-hover|peer-hover|\bhover:):(opacity-100|visible|flex|block)", asks=(), kinds=_SOURCE, include=_TYPED, **_REVIEWED),
    filed("craft-i18n-rtl-untested", "resilience", r"""className="[^"]*\b(ml-|mr-|pl-|pr-|left-|right-|text-(left|right)|float-(left|right)|border-(l|r))\b""", kinds=_SOURCE, include=_TYPED, **_REVIEWED),
    filed("craft-i18n-untested", "resilience", r"""^(?!.*dark:).*className="[^"]*\b(?:bg-white|bg-black|text-black|text-white|bg-gray-\d{2,3}|text-gray-\d{2,3}|border-gray-\d{2,3})\b[^"]*".*$""", "gum", kinds=_SOURCE, include=_TYPED, **_REVIEWED),
    filed("craft-inline-styles", "look-constraints", r"style=\{\{|<style\b", kinds=_SOURCE, include=_TSX, exclude=("**/components/ui/**",), **_REVIEWED),
    filed("craft-lazy-load-offscreen", "resilience", r"""<(?:img|Image)\b(?=[^>]*loading="lazy")(?=[^>]*(?:[Hh]ero|[Bb]anner|[Cc]over|[Mm]asthead|[Pp]riority))[^>]*>""", "gus", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("craft-left-accent-border", "elevation-and-edges", r"<(?!blockquote\b)[A-Za-z][\w.]*\b(?=[^>]*?\bborder-l-(?:2|4|8|\[\d+px\])(?![\w-]))(?=[^>]*?\bborder-(?:l-)?(?!(?:gray|zinc|slate|neutral|stone|border|input|muted|transparent|white|black)\b)(?:[a-z]+-\d{2,3}|primary|accent|brand)\b)(?=[^>]*?\brounded(?:-[a-z0-9]+)?\b)[^>]*>", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("craft-token-drift", "look-constraints", "@theme", kinds=_SOURCE, include=("**/*.css",), **_REVIEWED),
    filed("craft-viewport-scaling", "resilience", "export const viewport|<meta name=\"viewport\"", asks=(), kinds=_SOURCE, include=("**/*.md", "**/*.mdx", "**/*.tsx", "**/*.jsx"), **_REVIEWED),
    filed("engineering-catch-rethrow", "code-quality", r"\bcatch\s*\(\s*(\w+)\s*\)\s*\{\s*throw\s+\1\s*;?\s*\}", kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, **_REVIEWED),
    filed("engineering-ci-cancels-default-branch", "ci-pipeline", r"cancel-in-progress:\s*true\b", asks=(), kinds=_SOURCE, include=_WORKFLOWS, not_generated=True, severity="major", **_REVIEWED),
    filed("engineering-ci-coverage-on-pr", "ci-pipeline", r"--coverage\b|\btest:cov(?:erage)?\b|\bcoverage:\s*true\b", asks=(), kinds=_SOURCE, include=_WORKFLOWS, not_generated=True, **_REVIEWED),
    filed("engineering-ci-full-clone", "ci-pipeline", r"fetch-depth:\s*0\b", asks=(), kinds=_SOURCE, include=_WORKFLOWS, not_generated=True, **_REVIEWED),
    filed("engineering-ci-no-concurrency", "ci-pipeline", r"^\s*pull_request\s*:|^on:\s*\[?[^\n]*\bpull_request\b(?!_)", "gmu", absent=r"^\s*concurrency\s*:", kinds=_SOURCE, include=_WORKFLOWS, not_generated=True, **_REVIEWED),
    filed("engineering-ci-uncached-install", "ci-pipeline", r"\b(?:npm ci|npm install|pnpm install|yarn install|bun install)\b", absent=r"\bcache\s*:|actions/cache@|cache-dependency-path", kinds=_SOURCE, include=_WORKFLOWS, not_generated=True, **_REVIEWED),
    filed("engineering-dead-branch", "dead-code", r"\bif\s*\(\s*(?:false|0|!1|!true|null|undefined)\s*\)|\bwhile\s*\(\s*false\s*\)", kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, **_REVIEWED),
    filed("engineering-debug-log-in-ui", "code-quality", r"\bconsole\.(?:log|debug|dir|table)\s*\(", kinds=_SOURCE, include=("**/*.{tsx,jsx}",), exclude=_MADE, not_generated=True, **_REVIEWED),
    filed("engineering-empty-catch", "telemetry", r"\bcatch\s*(?:\(\s*[\w$]*\s*(?::\s*\w+\s*)?\))?\s*\{\s*\}|\.catch\(\s*\(\s*[\w$]*\s*\)\s*=>\s*\{\s*\}\s*\)", asks=(), kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, **_REVIEWED),
    filed("engineering-heavy-dependency", "performance", r"""(?:\bfrom\s*|\brequire\s*\(\s*|\bimport\s*\(\s*)["'](?:moment|moment-timezone|lodash|underscore|jquery|request|axios)["']""", kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, **_REVIEWED),
    filed("engineering-insecure-random-token", "sensitive-data", r"(?:token|secret|nonce|password|passcode|otp|salt|sessionId|apiKey|inviteCode|resetCode|verificationCode)\w*\s*[:=][^;\n]{0,80}Math\.random\(", "giu", kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, severity="major", **_REVIEWED),
    filed("engineering-non-atomic-writes", "data-access", r"\bawait\s+[\w$.()\[\]]*\.(?:create|createMany|insert|update|updateMany|upsert|delete|deleteMany|destroy|save)\s*\(", absent=r"\$transaction|\.transaction\s*\(|\btransaction\s*\(|\bBEGIN\b|\.batch\s*\(|\bwithTransaction\b", least=2, asks=(), kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, severity="major", **_REVIEWED),
    filed("engineering-query-in-loop", "data-access", r"(?:\bfor\s*(?:await\s*)?\([^)]*\)\s*\{|\.(?:forEach|map|flatMap)\s*\(\s*async\b)[\s\S]{0,400}?\bawait\s+[\w$.()\[\]]*?\.?(?:find\w*|query\w*|select\w*|insert\w*|update\w*|upsert\w*|delete\w*|execute|count|aggregate|get|fetch|load|from|sql|raw|rpc)\s*[(`]", asks=(), kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, severity="major", **_REVIEWED),
    filed("engineering-request-waterfall", "performance", r"(?:const|let)\s+[\w${}\[\],\s:]+=\s*await\s[^;\n]+;?[ \t]*\n\s*(?:const|let)\s+[\w${}\[\],\s:]+=\s*await\s", asks=(), kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, **_REVIEWED),
    filed("engineering-restating-comment", "code-quality", r"^[ \t]*//[ \t]*(?:Handle|Handles|Return|Returns|Initiali[sz]e|Get|Gets|Set|Sets|Create|Creates|Check|Checks|Loop|Iterate|Import|Define|Call|Calls|Update|Updates|Add|Adds|Render|Renders|Fetch|Fetches|Destructure|Increment|Declare|Export)\b[^\n]{0,60}$", "gmu", least=3, asks=(), kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, **_REVIEWED),
    filed("engineering-sensitive-data-logged", "sensitive-data", r"\b(?:console|logger|log|pino|winston)\.(?:log|info|warn|error|debug|trace)\s*\([^;\n]{0,160}?\b(?:password|passwd|secret|token|apiKey|api_key|accessToken|refreshToken|authorization|cookie|ssn|creditCard|cardNumber|cvv|dob|dateOfBirth|req\.body|request\.body|req\.headers|request\.headers)\b", "giu", asks=(), kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, severity="major", **_REVIEWED),
    filed("engineering-silent-fallback", "telemetry", r"""\bcatch\s*(?:\(\s*[\w$]*\s*(?::\s*\w+\s*)?\))?\s*\{[^{}]{0,240}?\breturn\b[^{};]{0,80}?(?:null|undefined|\[\s*\]|\{\s*\}|false|0|["'`]{2})\s*;?\s*\}""", asks=(), kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, **_REVIEWED),
    filed("engineering-stale-feature-flag", "dead-code", r"\b(?:const|let)\s+(?:[A-Z][A-Z0-9_]*_)?(?:ENABLE|ENABLED|FLAG|FEATURE|USE|SHOW|NEW|LEGACY|EXPERIMENT|EXPERIMENTAL|IS)_[A-Z0-9_]+\s*(?::\s*boolean\s*)?=\s*(?:true|false)\b|\b(?:const|let)\s+[A-Z][A-Z0-9_]*_(?:ENABLED|FLAG|FEATURE)\s*(?::\s*boolean\s*)?=\s*(?:true|false)\b", asks=(), kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, **_REVIEWED),
    filed("engineering-sync-io-in-handler", "performance", r"\b(?:readFileSync|writeFileSync|appendFileSync|readdirSync|statSync|execSync|execFileSync|spawnSync|pbkdf2Sync|scryptSync|gzipSync|gunzipSync|deflateSync|inflateSync|brotliCompressSync|brotliDecompressSync)\s*\(", asks=(), kinds=_SOURCE, include=("**/app/**/route.{ts,js,mts,mjs}", "**/app/**/actions.{ts,js}", "**/pages/api/**/*.{ts,js}", "**/middleware.{ts,js}", "**/server/**/*.{ts,js,mts,mjs}", "**/api/**/*.{ts,js,mts,mjs}", "**/routes/**/*.{ts,js,mts,mjs}", "**/handlers/**/*.{ts,js,mts,mjs}", "**/functions/**/*.{ts,js,mts,mjs}", "**/workers/**/*.{ts,js,mts,mjs}"), exclude=_MADE, not_generated=True, severity="major", **_REVIEWED),
    filed("engineering-template-residue", "code-quality", r"""//\s*TODO:?\s*(?:implement\b|add (?:error handling|logic|validation|your)|handle (?:the )?(?:error|this))|\b[Aa]dd your (?:logic|code|implementation) here\b|console\.log\(\s*["'`](?:here|test|debug|asdf|foo|bar|hit|called|reached|[0-9]+|x+)[!.]*["'`]\s*\)""", "giu", kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, **_REVIEWED),
    filed("engineering-test-focused", "test-value", r"\b(?:describe|it|test|context|suite)\.only\s*\(|\bf(?:it|describe)\s*\(", code_only=True, kinds=_SOURCE, include=_TESTS, not_generated=True, severity="major", **_REVIEWED),
    filed("engineering-test-mock-echo", "test-value", r"\.toHaveBeen(?:Called|CalledWith|CalledTimes|LastCalledWith|NthCalledWith)\s*\(|\.toHaveReturnedWith\s*\(", asks=(), kinds=_SOURCE, include=_TESTS, not_generated=True, **_REVIEWED),
    filed("engineering-test-render-only", "test-value", r"\brender(?:Hook)?\s*\(", absent=r"userEvent|fireEvent|\buser\.|\.click\(|\.type\(|\.keyboard\(|\brerender\b|\bact\s*\(|\bwaitFor\b", asks=(), kinds=_SOURCE, include=_TESTS, not_generated=True, **_REVIEWED),
    filed("engineering-test-self-comparison", "test-value", r"\bexpect\(\s*([\w$]+)\s*\)\s*\.\s*(?:toBe|toEqual|toStrictEqual)\(\s*\1\s*\)|\bassert\.(?:equal|strictEqual|deepEqual|deepStrictEqual)\(\s*([\w$]+)\s*,\s*\2\s*[,)]", code_only=True, kinds=_SOURCE, include=_TESTS, not_generated=True, severity="major", **_REVIEWED),
    filed("engineering-test-skipped", "test-value", r"""\b(?:describe|it|test|suite)\.(?:skip|todo)\s*\(\s*["'`]|\bx(?:it|describe|test)\s*\(\s*["'`]""", code_only=True, kinds=_SOURCE, include=_TESTS, not_generated=True, **_REVIEWED),
    filed("engineering-token-in-local-storage", "sensitive-data", r"""\b(?:localStorage|sessionStorage)\.setItem\(\s*["'`][^"'`]*(?:token|jwt|session|auth|credential)[^"'`]*["'`]""", "giu", kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, severity="major", **_REVIEWED),
    filed("engineering-unbounded-read", "data-access", r"""\.findMany\s*\(|\.find\s*\(\s*\{|\.from\(\s*["'`]\w+["'`]\s*\)\s*\.select\(|\bdb\s*\.\s*select\s*\(|\bSELECT\b[^;`]{1,300}?\bFROM\b""", asks=(), kinds=_SOURCE, include=_SCRIPTS, exclude=_MADE, not_generated=True, severity="major", **_REVIEWED),
    filed("interaction-a11y-color-only-meaning", "focus-and-a11y", r"\?[^:]*\b(text|bg|border)-(red|green|amber|emerald|rose|yellow)-\d", asks=(), kinds=_SOURCE, include=_TSX, severity="major", **_REVIEWED),
    filed("interaction-a11y-data-table-semantics", "focus-and-a11y", '<table\\b|role="(table|grid)"', absent='<caption\\b|scope="(col|row)"', kinds=_SOURCE, include=_TSX, severity="major", **_REVIEWED),
    filed("interaction-a11y-disabled-control-tooltip", "focus-and-a11y", r"<[^>]*\bdisabled\b[^>]*>[\s\S]{0,400}<(Tooltip|HoverCard)", "gus", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("interaction-a11y-icon-controls-labeled", "focus-and-a11y", r"<button\b(?![^>]*(aria-label|aria-labelledby|title=))[^>]*>\s*<[A-Z][\w.]*[^>]*/>\s*</button>", "gus", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("interaction-a11y-media-captions", "focus-and-a11y", r"<video\b|<audio\b", absent="kind=\"captions\"", kinds=_SOURCE, include=_TSX, severity="major", **_REVIEWED),
    filed("interaction-a11y-semantic-html-first", "focus-and-a11y", r"<(div|span|li|td)\b[^>]*\bonClick=", "gus", kinds=_SOURCE, include=_TSX, severity="major", **_REVIEWED),
    filed("interaction-a11y-tooltip-no-interactive", "focus-and-a11y", r"<(Tooltip(Content)?|HoverCard(Content)?)[^>]*>[\s\S]{0,800}<(button|a |input|select|textarea)\b", "gus", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("interaction-broken-focus-trap", "focus-and-a11y", "role=\"(dialog|alertdialog)\"", absent="@radix-ui/react-dialog|react-aria|focus-trap-react|@headlessui/react", kinds=_SOURCE, include=_TYPED, severity="major", **_REVIEWED),
    filed("interaction-dont-block-paste-ime", "form-usability", r"onPaste=\{[^}]*preventDefault", "gus", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("interaction-error-association", "form-usability", r"\{\s*[\w.?]*[Ee]rror[\w.?]*\s*&&", absent="aria-describedby", kinds=_SOURCE, include=_TSX, severity="major", **_REVIEWED),
    filed("interaction-focus-visible", "focus-and-a11y", r"outline:\s*(none|0)|\boutline-(none|hidden)\b", absent="focus-visible", kinds=_SOURCE, include=("**/*.css", "**/*.tsx", "**/*.jsx"), severity="major", **_REVIEWED),
    filed("interaction-inline-errors-first-focus", "form-usability", r"<form\b", absent=r"\.focus\(\)|autoFocus|shouldFocusError", asks=(), kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("interaction-input-affix-hit-target", "form-usability", r"<div[^>]*(flex|grid)[^>]*>\s*<(svg|Icon|Search|span)[^>]*>[\s\S]{0,400}<input\b", "gus", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("interaction-keyboard-operable", "focus-and-a11y", r"""<[A-Za-z][^>]*?\b(?:role="button"|tabIndex=\{[0-9])(?![^>]*?(?:onKeyDown|onKeyUp|onKeyPress))[^>]*?>""", "gus", kinds=_SOURCE, include=_TSX, severity="major", **_REVIEWED),
    filed("interaction-labels-and-autocomplete", "form-usability", r"<input\b(?![^>]*\bid=)(?![^>]*aria-label)[^>]*placeholder=", "gus", kinds=_SOURCE, include=_TSX, severity="major", **_REVIEWED),
    filed("interaction-lost-data-on-error", "form-usability", "<form", asks=(), kinds=_SOURCE, include=_TYPED, **_REVIEWED),
    filed("interaction-mobile-input-font-size", "form-usability", r"""\b(?:input|textarea|select)\b[^{}/]*\{[^}]*font-size:\s*(?:0?\.\d+rem|(?<![\d.])(?:\d|1[0-5])(?:\.\d+)?px)|<(?:input|textarea|select|Input|Textarea)\b[^>]*className="[^"]*\btext-(?:xs|sm)\b""", "gus", kinds=_SOURCE, include=("**/*.css", "**/*.tsx", "**/*.jsx"), **_REVIEWED),
    filed("interaction-no-disable-while-submitting", "form-usability", "<form", asks=(), kinds=_SOURCE, include=_TYPED, severity="major", **_REVIEWED),
    filed("interaction-no-empty-state", "state-coverage", r"\.length === 0|isEmpty", absent="Button|Link|<a |onClick", asks=(), kinds=_SOURCE, include=_TYPED, **_REVIEWED),
    filed("interaction-no-error-boundary", "state-coverage", "useQuery|useSWR", absent="ErrorBoundary", kinds=_SOURCE, include=_TYPED, severity="major", **_REVIEWED),
    filed("interaction-no-error-state", "state-coverage", r"\b(?:useQuery|useSWR|useSuspenseQuery|fetch)\s*\(", asks=(), kinds=_SOURCE, include=_TYPED, severity="major", **_REVIEWED),
    filed("interaction-no-suspense-boundary", "state-coverage", "^export (default )?async function", kinds=_SOURCE, include=_TYPED, **_REVIEWED),
    filed("interaction-not-restored", "focus-and-a11y", r"""role="dialog"|<Dialog\b|<Sheet\b""", absent="onCloseAutoFocus|triggerRef|finalFocus|returnFocusOnDeactivate", kinds=_SOURCE, include=_TYPED, severity="major", **_REVIEWED),
    filed("interaction-on-dynamic-content", "focus-and-a11y", r"router\.(push|replace)", absent=r"focus\(\)|aria-live", kinds=_SOURCE, include=_TYPED, **_REVIEWED),
    filed("interaction-optimistic-without-rollback", "state-coverage", r"useOptimistic\b", kinds=_SOURCE, include=_TYPED, severity="major", **_REVIEWED),
    filed("interaction-out-of-order-responses", "state-coverage", r"on(?:Change|Input)=[\s\S]{0,400}?(?:fetch\(|useQuery\(|axios\.)", absent="AbortController|useDeferredValue|signal:", kinds=_SOURCE, include=_TYPED, severity="major", **_REVIEWED),
    filed("interaction-target-size", "focus-and-a11y", r"""^(?=.*\b(?:h|w|size)-(?:[1-9]|10)\b).*(?:button|role="button").*$""", "gum", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("interaction-use-form-status-misuse", "form-usability", "useFormStatus", kinds=_SOURCE, include=_TYPED, severity="major", **_REVIEWED),
    filed("motion-pulse-dot", "motion-restraint", r"<(?:span|div)\b(?=[^>]*?\banimate-(?:ping|pulse)\b)(?=[^>]*?\brounded-full\b)(?=[^>]*?\b(?:size-(?:1|1\.5|2|2\.5|3)|h-(?:1|1\.5|2|2\.5|3))(?![\w.-]))[^>]*>", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("motion-will-change-misuse", "motion-restraint", r"""will-change\s*:\s*["'`]?(?!\s*(?:transform|opacity|auto)\s*["'`]?\s*[;},!])[a-z-]+|\bwill-change-(?:scroll|contents|\[(?!transform|opacity)[^\]]+\])""", "giu", kinds=_SOURCE, include=("**/*.css", "**/*.scss", "**/*.tsx", "**/*.jsx"), **_REVIEWED),
    filed("product-nested-modals", "control-choice", r"<(Dialog|AlertDialog|Modal|Sheet|Drawer)\b[^>]*>(?:(?!</\1>)[\s\S])*?<(?:Dialog|AlertDialog|Modal|Sheet|Drawer)\b[^>]*>", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("product-select-for-few-options", "control-choice", r"<(select|Select)\b[^>]*>(?:\s*<(option|SelectItem)\b[^>]*>[^<]*</\2>){2,3}\s*</\1>", "gus", kinds=_SOURCE, include=_TSX, **_REVIEWED),
    filed("seo-canonical-wrong-host", "search-visibility", r"""(?:canonical|metadataBase)[^\n]{0,40}?["'`](?:http://(?!localhost)[^"'`]+|https?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0)[:/][^"'`]*|https://[\w-]+\.vercel\.app[^"'`]*|https://[\w-]+\.netlify\.app[^"'`]*)["'`]""", kinds=_SOURCE, include=("**/*.{tsx,jsx,ts,js}", "**/*.html"), exclude=_MADE, not_generated=True, severity="major", **_REVIEWED),
    filed("seo-sitemap-build-time-lastmod", "search-visibility", r"lastModified\s*:\s*new\s+Date\(\s*\)|lastmod\s*:\s*new\s+Date\(\s*\)", kinds=_SOURCE, include=("**/sitemap.{ts,js,mjs,tsx}", "**/sitemap/**/*.{ts,js}"), not_generated=True, **_REVIEWED),
    filed("seo-unconditional-noindex", "search-visibility", r"""\brobots\s*:\s*\{[^}]*\bindex\s*:\s*false|\bnoindex\b|\brobots\s*:\s*["'`][^"'`]*noindex""", asks=(), kinds=_SOURCE, include=("**/*.{tsx,jsx,ts,js}", "**/*.html"), exclude=_MADE, not_generated=True, severity="major", **_REVIEWED),
    filed("typography-dashes", "typographic-detail", r"(?<=\S)--(?=\S)|(?<=\p{L}) - (?=\p{L})", kinds=_ALL, doc_types=_PROSE, not_in_code=True),
    filed("typography-ellipsis", "typographic-detail", r"\.\.\.", kinds=_ALL, doc_types=_PROSE, not_in_code=True, fix="ellipsis"),
    filed("typography-hover-weight-shift", "reading-comfort", r"hover:font-(?:thin|extralight|light|normal|medium|semibold|bold|extrabold|black)|data-\[(?:state=active|selected)\]:font-|aria-selected:font-|aria-current:font-", kinds=_SOURCE, include=("**/*.tsx", "**/*.jsx", "**/*.css"), **_REVIEWED),
    filed("typography-midpoint-separators", "typographic-detail", r"\S \| \S|\S • \S", kinds=("jsx-text", "attr-string", "paragraph"), roles=("body", "caption", "label", "list-item", "cell", "unknown"), not_in_code=True),
    filed("typography-multiplication-sign", "typographic-detail", r"(?<![\w.])[1-9]\d*\s?x\s?\d+(?![\w.%])", kinds=_ALL, doc_types=_PROSE, not_in_code=True, fix="multiplicationSign"),
    filed("typography-nbsp-value-unit", "typographic-detail", r"\d (?:px|pt|em|rem|ms|min|KB|MB|GB|TB|kg|km|cm|mm|fps|%)(?![\p{L}\d])", kinds=_COPY, doc_types=_PROSE, not_in_code=True, fix="nbspValueUnit"),
    filed("typography-readable-scale", "reading-comfort", r"(?:\bbody\b|\bhtml\b|:root|\.prose)[^{}/]*\{[^}]*font-(?:size:\s*(?:0?\.\d+rem|(?<![\d.])(?:\d|1[0-5])(?:\.\d+)?px)|weight:\s*[123]00\b)", "gus", kinds=_SOURCE, include=("**/*.css", "**/*.scss"), **_REVIEWED),
    filed("typography-straight-quotes", "typographic-detail", r""""|(?<=\p{L})'(?=\p{L})|(?<=\s)'(?=\d)""", kinds=_ALL, doc_types=("tutorial", "howto", "reference", "explanation", "lesson", "marketing", "ui", "unknown", "readme"), not_in_code=True, own_quotes=False, fix="smartQuotes"),
    filed("typography-title-case-heading", "typographic-detail", "^(?:[A-Z][a-z]+|of|the|and|for|to|a|in|on|with)(?: (?:[A-Z][a-z]+|of|the|and|for|to|a|in|on|with)){2,}[?!:.]?$", "u", asks=("role",), kinds=("heading", "jsx-text", "attr-string"), exclude=("**/README.md",), doc_types=_PROSE, roles=("heading", "button", "label", "aria"), not_in_code=True, **_STYLE),
    filed("typography-trending-display-serif", "type-voice", r"""Instrument_Serif\s*\(|Instrument\+Serif|font-family:\s*["']?Instrument Serif""", kinds=_SOURCE, include=("**/*.tsx", "**/*.jsx", "**/*.ts", "**/*.css"), **_REVIEWED),
)
