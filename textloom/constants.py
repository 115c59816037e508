"""Word lists, maps and fixed parameters of the text functions, kept as data."""

from __future__ import annotations


def _split(joined: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in joined.split("|") if x.strip())


def _inverted(groups: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {member: name for name, members in groups.items() for member in members}


# Index and concept vocabulary
COMMON_WORDS = frozenset(
    """
    a i be he me we if of an in on do go no so to up or as is at it by my had did old and see she the one are
    use off big all him can own who too two her per for nor our has was his its get let set got not but out you
    few new how low now may way why data need used good once made make take like same time come some type dare
    here were more case note have long each much such high with both back work task well will full them whom
    from than been then when even main upon down also into over your does this less thus that what left part
    last best most just next show know they only many very basic based noted could would hence since large table
    while there where these those whose state quite above being using among young which final total model shall
    small still often given again shown under other after their tasks great might right ought first about input
    below early every should method single simple little entire before figure denote during obtain within common
    number rather either better models result recent almost output simply nearly instead provide example because
    achieve getting through special several between certain section similar whether neither another further
    chapter however methods denotes results various current without complex already usually specific provided
    obtained achieved standard describe possible multiple separate original consider moreover previous described
    available therefore following describes important different represent typically generally considered
    correspond additional represented furthermore respectively specifically additionally particularly
    corresponding
    """.split()
)
NOISE_TERMS = frozenset(
    """
    al pp et pdf fig org doi acl vol url acm com abs net edu www ieee page aaai etal icml isbn issn http iclr
    table issue naacl emnlp pages https press draft arxiv volume figure journal neurips accepted workshop
    preprint appendix published submitted institute symposium conference department manuscript university
    proceedings
    """.split()
)
# The wider lists of the general text utilities
GENERAL_WORDS = frozenset(
    """
    a i be he me we if of an in on do go no so to up or as is at it by my had did old and see she the one are
    use off big all him can man ten own who too two her per for nor our has was his its get let set got hot not
    but out you few new how now six day may way key why area data need used cold hand good hard once made wide
    free life make take like same time come some nine type dare here were core more case rate note true have
    five long each much such high with both weak back dark work task real well will full them whom from form
    than been then when open even main thin upon down zero also into deep year over four your does this less
    thus that what flat fact left soft part fast last best most just next show slow know they only many very
    basic based noted fixed valid child world could would hence since three large table while there where these
    false those whose state white quite value above being thing using among young which black thick local final
    total equal model level shall small still woman often seven given again shown group wider older under order
    safer other inner upper rarer later after outer newer lower their major minor tasks great eight light might
    right ought point first about input below study fully early every public static shared closed should method
    change single simple little entire before figure finite denote unique during strong global formal actual
    system random obtain within common linear number harder longer larger richer higher rather either easier
    weaker darker former deeper poorer denser closer lesser softer faster latter better vaguer slower models
    effect direct result recent almost output narrow mainly simply nearly dynamic instead related invalid
    provide average example because private achieve getting through logical special partial optimal general
    several central natural digital virtual overall problem minimum maximum between certain section similar
    broader rougher whether neither another further riskier earlier heavier thicker smaller simpler cleaner
    thinner cheaper clearer sparser greater lighter chapter shorter however methods denotes process results
    various correct current without shallow complex already largely roughly totally usually exactly country
    specific provided obtained combined expected achieved standard describe variable possible multiple separate
    complete concrete discrete infinite negative positive approach research physical original internal external
    parallel consider stronger smoother brighter moreover inferior superior analysis previous abstract indirect
    dominant constant entirely directly described available therefore effective following practical identical
    potential describes incorrect important efficient different represent precisely inversely primarily
    typically initially partially generally necessary considered associated correspond compatible respective
    sequential additional peripheral continuous sufficient equivalent government consistent ultimately
    completely absolutely relatively originally eventually previously represented distributed centralized
    furthermore appropriate alternative traditional significant development secondarily essentially conventional
    proportional inconsistent respectively specifically additionally particularly subsequently consequently
    corresponding approximately comparatively fundamentally
    """.split()
)
GENERAL_NOISE = frozenset(
    """
    al pp et pdf fig org doi acl vol url acm com abs net mit edu www ieee page aaai etal icml isbn issn http
    iclr table issue naacl emnlp pages https press draft arxiv wiley pubmed oxford volume figure scopus bibtex
    harvard license journal version neurips accepted stanford revision workshop citeseer springer elsevier
    preprint appendix berkeley published submitted cambridge institute symposium copyright conference department
    manuscript university proceedings
    """.split()
)
DOMAIN_STOPWORDS = frozenset(
    """
    see set data used page note work also thus show based hence table using model given shown paper study method
    figure common result example general problem section similar chapter however methods results specific
    proposed standard possible approach research equation solution moreover analysis available therefore
    according algorithm important different particular furthermore significant respectively additionally
    """.split()
)
# Function words that queries ignore: when gating, reranking and choosing documents
GATE_STOP_WORDS = frozenset(
    """
    a i be he me we of an in on do to or is at it my had did and she the are can for our has was its but you how
    why were have with them been when your does this that what they could would where being about should
    """.split()
)
RERANK_STOP_WORDS = frozenset(
    """
    a i be he me we of an in on do to up or as is at it by my had did and she the are can for our has was its
    but you how why were have with them from been when down into your does this that what they could would where
    being after about should before during through
    """.split()
)
RELEVANCE_STOP_WORDS = frozenset(
    """
    a i be he me we of an in on do to up or is at it my had did and she the are can for our has was its but you
    how why were have with them been when down your does this that what they could would where being about
    should
    """.split()
)
# First match in this order wins
DOMAINS = {
    'academic': _split(
        "doi | cite | peer | arxiv | thesis | review | journal | reviewed | research | citation | findings | "
        "analysis | abstract | appendix | professor | literature | conclusion | references | hypothesis | "
        "experiment | university | proceedings | methodology | dissertation | introduction | bibliography "
    ),
    'technical': _split(
        "merge | debug | module | branch | server | commit | client | deploy | runtime | version | pipeline | "
        "database | optimize | protocol | compiler | refactor | interface | framework | algorithm | component | "
        "deployment | repository | architecture | configuration | implementation "
    ),
    'business': _split(
        "roi | kpi | chain | audit | growth | fiscal | merger | budget | market | profit | supply | revenue | "
        "dividend | strategy | valuation | portfolio | logistics | quarterly | inventory | compliance | "
        "regulation | acquisition | stakeholder | shareholder | procurement | sustainability "
    ),
    'legal': _split(
        "court | party | clause | ruling | statute | counsel | whereas | parties | verdict | subpoena | evidence "
        "| contract | attorney | plaintiff | provision | defendant | agreement | testimony | liability | "
        "litigation | deposition | arbitration | hereinafter | jurisdiction | indemnification "
    ),
    'medical': _split(
        "trial | dosage | biopsy | vaccine | symptom | patient | anatomy | surgery | clinical | oncology | "
        "diagnosis | prognosis | treatment | pathology | radiology | neurology | morbidity | mortality | "
        "cardiology | physiology | immunology | therapeutic | prescription | pharmaceutical "
    ),
    'science': _split(
        "atom | model | sample | genome | theory | climate | control | quantum | physics | species | ecology | "
        "geology | biology | variable | molecule | spectrum | electron | evolution | chemistry | simulation | "
        "hypothesis | experiment | calibration | observation | measurement "
    ),
    'self_help': _split(
        "goal | habit | growth | vision | balance | routine | failure | purpose | journal | success | mindset | "
        "wellness | manifest | gratitude | discipline | meditation | motivation | reflection | affirmation | "
        "accountability "
    ),
    'history': _split(
        "era | war | period | empire | treaty | ancient | century | dynasty | republic | heritage | colonial | "
        "medieval | artifact | conquest | monarchy | chronicle | migration | tradition | revolution | archaeology "
        "| independence | civilization "
    ),
    'code': _split(
        "test | async | build | debug | class | await | method | module | import | deploy | package | compile | "
        "runtime | closure | promise | iterate | library | variable | callback | function | refactor | abstract | "
        "interface | dependency | inheritance | polymorphism | encapsulation "
    ),
    'finance': _split(
        "bond | fund | rate | cash | debt | flow | yield | stock | sheet | asset | index | income | margin | "
        "market | equity | balance | exchange | interest | currency | deflation | inflation | statement | "
        "liability "
    ),
}
METADATA_DOMAINS = {
    'academic': _split(
        "doi | ibid | cite | peer | et al | arxiv | thesis | review | journal | reviewed | research | citation | "
        "findings | analysis | abstract | appendix | professor | literature | conclusion | references | "
        "hypothesis | experiment | university | proceedings | methodology | dissertation | introduction | "
        "bibliography "
    ),
    'technical': _split(
        "api | sdk | merge | debug | module | branch | docker | server | commit | client | deploy | runtime | "
        "version | pipeline | database | protocol | compiler | refactor | interface | framework | algorithm | "
        "component | kubernetes | deployment | repository | microservice | architecture | configuration | "
        "implementation "
    ),
    'business': _split(
        "roi | kpi | chain | audit | growth | fiscal | merger | budget | market | profit | supply | revenue | "
        "dividend | strategy | valuation | portfolio | logistics | quarterly | inventory | compliance | "
        "regulation | acquisition | stakeholder | shareholder | procurement | sustainability "
    ),
    'legal': _split(
        "bar | court | party | clause | ruling | statute | counsel | whereas | parties | verdict | subpoena | "
        "evidence | contract | attorney | plaintiff | provision | defendant | agreement | testimony | liability | "
        "litigation | deposition | arbitration | hereinafter | jurisdiction | indemnification "
    ),
    'medical': _split(
        "lab | trial | dosage | biopsy | vaccine | symptom | patient | anatomy | surgery | clinical | specimen | "
        "oncology | diagnosis | prognosis | treatment | pathology | radiology | neurology | mortality | "
        "cardiology | physiology | immunology | therapeutic | prescription | pharmaceutical "
    ),
    'science': _split(
        "data | atom | model | sample | genome | proton | theory | climate | control | neutron | physics | "
        "species | ecology | geology | biology | variable | molecule | spectrum | electron | evolution | "
        "chemistry | simulation | hypothesis | experiment | calibration | observation | measurement "
    ),
    'self_help': _split(
        "goal | habit | growth | vision | balance | routine | failure | purpose | journal | success | mindset | "
        "wellness | manifest | gratitude | discipline | meditation | motivation | reflection | affirmation | "
        "accountability "
    ),
    'history': _split(
        "era | war | period | empire | treaty | ancient | century | dynasty | republic | heritage | colonial | "
        "medieval | artifact | conquest | monarchy | chronicle | migration | tradition | revolution | archaeology "
        "| independence | civilization "
    ),
}
LANGUAGE_WORDS = {
    'en': _split(
        "is | had | the | are | has | was | were | have | with | will | from | been | this | that | they | could "
        "| would | their | about | should "
    ),
    'es': _split(
        "la | el | del | por | las | los | muy | para | como | pero | puede | desde | tiene | estas | estos "
    ),
    'fr': _split(
        "une | sur | pas | des | les | est | avec | leur | pour | mais | dans | nous | vous | sont | cette "
    ),
    'de': _split(
        "und | die | auf | ein | der | das | mit | ist | eine | auch | kann | aber | haben | nicht | werden "
    ),
    'pt': _split(
        "uma | que | foi | tem | com | nao | sao | por | para | esta | pode | como | isso | mais | muito "
    ),
    'it': _split(
        "una | che | del | con | non | per | piu | come | sono | dopo | della | anche | stato | molto | questo "
    ),
    'nl': _split(
        "en | nog | bij | ook | wel | dan | van | een | dat | het | veel | zijn | maar | voor | niet "
    ),
    'ru': _split(
        "в | и | за | на | не | из | он | но | по | она | как | его | что | это | быть "
    ),
    'zh': _split(
        "不 | 也 | 了 | 他 | 们 | 在 | 她 | 它 | 就 | 我 | 是 | 有 | 的 | 这 | 都 "
    ),
    'ja': _split(
        "が | さ | し | た | て | で | と | に | の | は | れ | を | ある | いる | する "
    ),
    'ko': _split(
        "가 | 과 | 는 | 로 | 를 | 에 | 와 | 은 | 을 | 의 | 이 | 한 | 하다 | 으로 | 에서 "
    ),
    'ar': _split(
        "مع | كل | أن | من | هو | في | هي | هذا | كما | وقد | كان | إلى | على | التي | الذي "
    ),
}
FORMATS = {
    'pdf': _split(
        "pdf "
    ),
    'text': _split(
        "log | eml | txt | text "
    ),
    'html': _split(
        "htm | html | xhtml "
    ),
    'markdown': _split(
        "md | mkd | mdown | markdown "
    ),
    'rst': _split(
        "rst | rest "
    ),
    'xml': _split(
        "xml "
    ),
    'image': _split(
        "gif | tif | png | jpg | svg | ico | bmp | tiff | jpeg | webp "
    ),
    'docx': _split(
        "docx "
    ),
    'doc': _split(
        "doc "
    ),
    'rtf': _split(
        "rtf "
    ),
    'odt': _split(
        "odt "
    ),
    'pptx': _split(
        "pptx "
    ),
    'ppt': _split(
        "ppt "
    ),
    'odp': _split(
        "odp "
    ),
    'xlsx': _split(
        "xlsx "
    ),
    'xls': _split(
        "xls "
    ),
    'ods': _split(
        "ods "
    ),
    'csv': _split(
        "csv | tsv "
    ),
    'json': _split(
        "json | jsonl "
    ),
    'yaml': _split(
        "yml | yaml "
    ),
    'toml': _split(
        "toml "
    ),
    'code': _split(
        "c | h | m | r | v | rb | cc | sh | el | jl | ml | pl | pm | go | cs | hs | js | rs | ts | kt | ex | py | "
        "ps1 | lua | cmd | vue | zig | zsh | mli | clj | sql | erl | nim | php | cpp | hpp | lhs | cjs | mjs | "
        "css | kts | exs | bat | rkt | pyw | jsx | tsx | cxx | hxx | java | cljc | bash | fish | lisp | cljs | "
        "sass | scss | less | dart | scala | cmake | swift | gradle | svelte | makefile | dockerfile "
    ),
}
EXTENSION_FORMAT = _inverted(FORMATS)
CONTENT_TYPES = {
    'pdf': _split(
        "application/pdf "
    ),
    'html': _split(
        "text/html "
    ),
    'markdown': _split(
        "text/markdown "
    ),
    'text': _split(
        "text/plain "
    ),
    'csv': _split(
        "text/csv "
    ),
    'json': _split(
        "application/json "
    ),
    'xml': _split(
        "text/xml | application/xml "
    ),
    'docx': _split(
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document "
    ),
    'pptx': _split(
        "application/vnd.openxmlformats-officedocument.presentationml.presentation "
    ),
    'xlsx': _split(
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet "
    ),
    'doc': _split(
        "application/msword "
    ),
    'ppt': _split(
        "application/vnd.ms-powerpoint "
    ),
    'xls': _split(
        "application/vnd.ms-excel "
    ),
    'image': _split(
        "image/gif | image/png | image/tiff | image/jpeg | image/webp "
    ),
}
CONTENT_TYPE_FORMAT = _inverted(CONTENT_TYPES)
CODE_LANGUAGES = {
    'python': _split(
        "py | pyw "
    ),
    'javascript': _split(
        "js | cjs | mjs | jsx "
    ),
    'typescript': _split(
        "ts | tsx "
    ),
    'java': _split(
        "java "
    ),
    'c': _split(
        "c | h "
    ),
    'cpp': _split(
        "cc | cpp | hpp | cxx | hxx "
    ),
    'csharp': _split(
        "cs "
    ),
    'go': _split(
        "go "
    ),
    'rust': _split(
        "rs "
    ),
    'ruby': _split(
        "rb "
    ),
    'php': _split(
        "php "
    ),
    'swift': _split(
        "swift "
    ),
    'kotlin': _split(
        "kt | kts "
    ),
    'scala': _split(
        "scala "
    ),
    'r': _split(
        "R | r "
    ),
    'objc': _split(
        "m "
    ),
    'shell': _split(
        "sh | zsh | bash | fish "
    ),
    'powershell': _split(
        "ps1 "
    ),
    'batch': _split(
        "cmd | bat "
    ),
    'sql': _split(
        "sql "
    ),
    'css': _split(
        "css "
    ),
    'scss': _split(
        "scss "
    ),
    'sass': _split(
        "sass "
    ),
    'less': _split(
        "less "
    ),
    'lua': _split(
        "lua "
    ),
    'perl': _split(
        "pl | pm "
    ),
    'elixir': _split(
        "ex | exs "
    ),
    'erlang': _split(
        "erl "
    ),
    'haskell': _split(
        "hs | lhs "
    ),
    'ocaml': _split(
        "ml | mli "
    ),
    'clojure': _split(
        "clj | cljc | cljs "
    ),
    'lisp': _split(
        "lisp "
    ),
    'emacs_lisp': _split(
        "el "
    ),
    'racket': _split(
        "rkt "
    ),
    'dart': _split(
        "dart "
    ),
    'zig': _split(
        "zig "
    ),
    'nim': _split(
        "nim "
    ),
    'v': _split(
        "v "
    ),
    'julia': _split(
        "jl "
    ),
    'vue': _split(
        "vue "
    ),
    'svelte': _split(
        "svelte "
    ),
    'docker': _split(
        "dockerfile "
    ),
    'make': _split(
        "makefile "
    ),
    'cmake': _split(
        "cmake "
    ),
    'gradle': _split(
        "gradle "
    ),
}
EXTENSION_LANGUAGE = _inverted(CODE_LANGUAGES)
