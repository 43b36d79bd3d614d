"""Word lists and patterns of the measurement domain (Brazilian data-protection notices).

All of these are fixed values: results depend on them being exactly these.  Every operator takes its
lexicon as a parameter with one of these as default.
"""

# Link categories and their patterns, in order of precedence.
LINK_CATEGORIES = {
    "politica_privacidade": [
        r"polit\w+[\s_\-]*de[\s_\-]*privacid", r"aviso[\s_\-]*de[\s_\-]*privacid", r"privacy[\s_\-]*policy", r"\blgpd\b",
        r"prote\w*[\s_\-]*de[\s_\-]*dados", r"notifica\w*[\s_\-]*de[\s_\-]*privacid", r"declara\w*[\s_\-]*de[\s_\-]*privacid",
        r"portal[\s_\-]*de[\s_\-]*privacid", r"central[\s_\-]*de[\s_\-]*privacid", r"privacy[\s_\-]*notice", r"privacy[\s_\-]*statement",
        r"\bprivacidade\b", r"\bprivacy\b", r"\bpol[ií]ticas\b",
    ],
    "termos_uso": [r"termos[\s_\-]*de[\s_\-]*uso", r"termos[\s_\-]*de[\s_\-]*servic", r"terms[\s_\-]*of[\s_\-]*(use|service)", r"condi\w*[\s_\-]*de[\s_\-]*uso"],
    "encarregado": [r"encarregad\w+", r"\bdpo\b", r"data[\s_\-]*protection[\s_\-]*officer", r"fale[\s_\-]*conosco.*lgpd", r"contato.*prote\w*[\s_\-]*de[\s_\-]*dados"],
    "canal_titular": [
        r"portal[\s_\-]*do[\s_\-]*titular", r"central[\s_\-]*do[\s_\-]*titular", r"canal[\s_\-]*do[\s_\-]*titular", r"\bseus[\s_\-]*direitos\b",
        r"direitos[\s_\-]*do[\s_\-]*titular", r"exerc\w*[\s_\-]*de[\s_\-]*direitos", r"requisi\w*[\s_\-]*lgpd", r"solicita\w*[\s_\-]*lgpd",
    ],
    "acesso_informacao_gov": [r"acesso[\s_\-]*[àa][\s_\-]*informa\w*", r"acessoinforma\w*", r"\btranspar\w*", r"\be[\s_\-]*sic\b", r"\bouvidor\w*"],
}
SECOND_LEVEL_CATEGORIES = ["politica_privacidade", "encarregado", "canal_titular"]
PATH_BLOCKERS = [r"/noticias?/", r"/blog/", r"/artigos?/", r"/materias?/", r"/post/", r"/imprensa/", r"\.ghtml", r"/videos?/", r"/galeria/"]

# Policy pages.
WEAK_POLICY_PATTERNS = [r"\bprivacidade\b", r"\bprivacy\b", r"\blgpd\b"]
POLICY_PATH = r"(privacid|privacy|gdpr|lgpd|prote\w*[-_]?(?:de[-_]?)?dados|dados[-_]?pessoais|polit\w*[-_]?de[-_]?dados)"
POLICY_KEYWORDS = [
    "lgpd", "lei geral de proteção de dados", "lei nº 13.709", "13.709", "base legal", "bases legais", "finalidade", "compartilhamento", "retenção",
    "retencao", "titular dos dados", "titular dos seus dados", "encarregado", "anpd", "autoridade nacional", "direitos do titular", "consentimento",
    "tratamento de dados", "dados pessoais", "transferência internacional", "transferencia internacional",
]
MIN_PAGE_BYTES = 500
MIN_KEYWORDS = 3

# PDF documents.
PDF_PRIVACY = r"(?i)(privacidad|privacy|prote[cç][aã]o[\s_%+.\-]*de[\s_%+.\-]*dados|lgpd|dados[\s_%+.\-]*pessoa|aviso[\s_%+.\-]*de[\s_%+.\-]*privac|encarregad|\bdpo\b)"
PDF_REFERENCE = (
    r"(?i)(guia|cartilha|manual|e-?book|apresenta|boas[\s_%+.\-]*pr[aá]ticas|gloss[aá]rio|cartaz|folder|curso|treinamento|palestra"
    r"|pol[ií]tica[\s_%+.\-]*nacional|pol[ií]ticas[\s_%+.\-]*p[uú]blicas)"
)
PDF_THIRD_PARTY = r"(?i)(gstatic\.com|\.adobe\.com)"

# Marks of an anti-bot challenge, as header and the part of its value that shows it (None: the header alone).
CHALLENGE_MARKS = [("cf-mitigated", "challenge"), ("content-security-policy", "challenges.cloudflare.com"), ("x-datadome", "protected"), ("x-px-block", None)]

# Channel for data subjects.
EMAIL = r"\b([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.(?:com|com\.br|br|gov\.br|org|org\.br|edu|edu\.br|net|net\.br))\b"
RULE_EMAIL_PREFIXES = ["dpo", "encarregado", "encarregada", "privacidade", "lgpd", "protecaodedados", "protecao.dados", "protecao_dados", "dataprotection", "data.protection"]
MODEL_EMAIL_PREFIXES = ["dpo", "encarregado", "encarregada", "privacidade", "lgpd", "protecaodedados", "protecao.dados", "protecao_dados", "meusdados"]
RULE_PROVIDERS = [
    "cloudflare.com", "cloudfront.net", "akamai.com", "akamaihd.net", "fastly.com", "amazonaws.com", "wordpress.com", "automattic.com", "shopify.com", "wix.com",
    "wixpress.com", "squarespace.com", "hubspot.com", "zendesk.com", "salesforce.com",
]
MODEL_PROVIDERS = [*RULE_PROVIDERS, "google.com", "gstatic.com", "adobe.com", "sentry.io", "example.com"]
ANCHOR_OFFICER = r"\bencarregad[oa]\b|\bdpo\b|data\s+protection\s+officer"
ANCHOR_RIGHTS = (
    r"portal\s+do\s+titular|central\s+do\s+titular|canal\s+do\s+titular|seus\s+direitos|direitos\s+do\s+titular"
    r"|exerc\w+\s+(?:de\s+|seus\s+)?direitos|requisi\w+\s+lgpd|solicita\w+\s+lgpd|titular\s+dos\s+dados"
)
PHONE = r"tel:[+0-9()\s.\-]{8,}|\(?\d{2}\)?\s?\d{4,5}[\-\s.]?\d{4}"
CHANNEL_KEYWORDS = ["titular", "direito", "lgpd", "exercer", "exercicio", "exercício", "encarregado", "dpo", "solicitacao", "solicitação", "requisicao", "requisição", "fale conosco"]
CHANNEL_WINDOW = 200
CHANNEL_HTML_LIMIT = 2_000_000
CHANNEL_GENERIC_LIMIT = 60

# Coefficients of the channel model.
CHANNEL_COEFFICIENTS = {
    "intercept": -2.4133975117600195, "F1": 4.496324086347602, "F2": 3.586165601360079, "F3": 2.5094884774408435, "F4": 0.6254989633267973,
    "F5": -0.44014105005106224, "F6": -1.1655843372003176, "F7": 1.2272371662772121, "F8": 1.7914867591311867,
}

# Cookie banners.
BANNER_VENDORS = {
    "OneTrust": [r"id\s*=\s*[\"']onetrust-banner-sdk[\"']", r"id\s*=\s*[\"']onetrust-consent-sdk[\"']", r"class\s*=\s*[\"'][^\"']*optanon-alert-box-wrapper[^\"']*[\"']"],
    "Cookiebot": [r"id\s*=\s*[\"']CybotCookiebotDialog[\"']", r"CybotCookiebotDialog"],
    "QuantcastChoice": [r"class\s*=\s*[\"'][^\"']*qc-cmp2-container[^\"']*[\"']", r"id\s*=\s*[\"']qc-cmp2-ui[\"']"],
    "CookieConsent": [r"id\s*=\s*[\"']cookieconsent[\"']", r"class\s*=\s*[\"'][^\"']*cc-banner[^\"']*[\"']"],
    "Termly": [r"termly\.io", r"id\s*=\s*[\"']termly-code-snippet-support[\"']"],
    "TrustArc": [r"id\s*=\s*[\"']truste-consent-track[\"']", r"truste\.com"],
    "Klaro": [r"id\s*=\s*[\"']klaro[\"']", r"class\s*=\s*[\"'][^\"']*klaro[^\"']*[\"']"],
    "Osano": [r"osano-cm-window", r"class\s*=\s*[\"'][^\"']*osano[^\"']*[\"']"],
    "Cookieyes": [r"class\s*=\s*[\"'][^\"']*cky-(?:notice|banner|consent-container|overlay|modal)[^\"']*[\"']"],
    "Complianz": [r"id\s*=\s*[\"']cmplz-cookiebanner-container[\"']", r"class\s*=\s*[\"'][^\"']*cmplz-cookiebanner[^\"']*[\"']"],
}
BANNER_LOADERS = ["termly.io", "truste.com"]
BANNER_CONTAINERS = ["cookie", "consent", "lgpd", "privacid", "privacidade", "privacy", "gdpr"]
BANNER_WORDS = [
    r"\bcookies?\b", r"rastreamento", r"experi\w+\s+de\s+navega\w+", r"consentimento", r"continuar\s+navegando", r"aceitar\s+(todos?|cookies)", r"concordo",
    r"permitir\s+cookies", r"accept\s+cookies", r"cookie\s+(banner|notice|consent|preferences)", r"we\s+use\s+cookies",
]
HIDDEN_CLASS = r"(?:^|\s)(?:cc-invisible|[a-z0-9_]+-invisible|invisible|hidden|is-hidden|d-none|sr-only|visually-hidden)(?:\s|$)"
NONVISUAL_TAGS = ["script", "style", "link", "meta", "noscript", "template", "head", "title", "base"]
BANNER_ANCESTORS = 6

# Pages that need JavaScript.
SHELL_MARKERS = [
    r"<noscript>.*?(JavaScript|javascript).*?</noscript>", r"(enable|habilit\w+).{0,30}(JavaScript|javascript)",
    r"(você|voce).{0,20}(precisa|necessita).{0,20}(JavaScript|javascript)", r"<div\s+id=[\"'](root|app|__next|main|__nuxt|svelte)[\"']\s*></div>",
    r"You need to enable JavaScript to run this app", r"This (app|application) requires JavaScript",
]

# Text preparation.
ABBREVIATIONS = [
    "art", "arts", "inc", "incs", "par", "cf", "ex", "pp", "pag", "pág", "fl", "fls", "cap", "caps", "sec", "seç", "ltda", "cia", "sr", "sra", "srs", "dr", "dra",
    "prof", "profa", "av", "etc", "vol", "ed", "org", "coord", "trad", "aprox", "obs", "ref", "min", "máx", "n", "no", "nº",
]
FOREIGN_WORDS = (
    "the your you we our and for with information data privacy policy personal may will shall that this which use are is to of in on by from any such these been"
    " have has does do not"
).split()
OWN_WORDS = r"o|a|os|as|de|da|do|dos|das|que|para|com|seu|sua|seus|suas|voc[êe]|n[óo]s|dados|informa[çc][õo]es|privacidade|pol[íi]tica|pode|podem|ser[áa]|em|ao|pelo|pela|nao|n[ãa]o|uma|um|seja"
ITEM_MARK = r"^(?:\(\s*(?:[ivxlcdm]{1,5}|[a-zA-Z]|\d+)\s*\)|[a-z]\)|[a-z]\.|\d+(?:\.\d+)*[.)]|[IVXLCDM]{1,5}\.)(?:\s|$)"
# Upper-case letters that begin a sentence, and the bracketed item marks at which a text is split.
UPPER = "A-ZÀ-Ú"
BRACKET_MARK = r"\((?:[IVXivx]{1,5}|[A-Za-z])\)"
# Least segment, least text for the language ratio, the ratio, repeats of a page line, longest line that can recur.
MIN_SEGMENT, MIN_LANGUAGE, LANGUAGE_RATIO, PAGE_REPEATS, MAX_RECURRENT = 20, 400, 1.4, 3, 150

# Personal data.
PERSONAL_DATA = {
    "correio": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "telefone": r"(?<![0-9A-Fa-f])\(?\d{2}\)?[\s-]?9?\d{4}[-\s]?\d{4}(?![0-9A-Fa-f])",
    "cpf": r"\d{3}\.\d{3}\.\d{3}-\d{2}",
    "cnpj": r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}",
}

# Sampling.
EXCLUDED_HOST_PARTS = ["bit.ly", "t.co", "goo.gl", "ow.ly", "tinyurl", "cloudfront", "akamai", "fastly", "edgekey", "edgesuite", "mlstatic", "gstatic", "googleusercontent"]
PUBLIC_SUFFIXES = ["com", "net", "org", "br", "com.br", "net.br", "org.br", "gov.br", "edu.br", "jus.br", "mp.br", "def.br", "leg.br", "example.com", "example.net", "example.org"]

# Scalars of an audit trail that become columns, and the columns before them.
AUDIT_SCALARS = [
    "n_sentencas_sinalizadas", "n_segmentos_avaliados", "limiar", "cobertura_vocabulario", "extrapolacao", "motivo", "modelo_sha256", "preparo_versao",
    "extrator_versao", "corpo_sha256",
]
RESULT_COLUMNS = ["domain_url", "variable_name", "value", "confidence", "run_id", "protocol_version", "plugin_version", "computed_at"]
STATES = ["true", "false", "nao_aplicavel", "nao_coletado"]
CONFIDENCE = {"high": 0.95, "medium": 0.65, "low": 0.35, "unknown": 0.0}

# Rules for three requirements of a notice, on normalised text.
_LINK = r"(?:\bpara\b|\ba fim de\b|\bcom (?:o objetivo|a finalidade|o proposito|o intuito) de\b|\bvisando\b|\bdestinad[oa]s? a\b|\bfinalidades?\b)"
_ACTIVITY = (
    r"(?:process\w+|entreg\w+|envi\w+|cadastr\w+|identific\w+|autentic\w+|personaliz\w+|recomend\w+|analis\w+|estatistic\w+|marketing|publicidad\w+|anunci\w+|cobran\w+"
    r"|fatur\w+|pagament\w+|prevenc\w+|fraude|contat\w+|comunica\w+|atendiment\w+|suport\w+|newsletter|promoc\w+|ofert\w+|lembr\w+|reconhec\w+|login|navegac\w+|metric\w+"
    r"|pesquis\w+|contrat\w+|pedido|compra|vend\w+|selec\w+|recrut\w+|vaga|curriculo|agendament\w+|exame|consulta|obrigac\w+|cumprir?|seguran\w+|auditor\w+)"
)
_ABROAD = r"(?:fora do (?:brasil|pais)|no exterior|em outros paises|nos estados unidos|\beua\b|internacionalmente|transfronteir\w+)"
_HANDLING = r"(?:transferi\w+|transmit\w+|armazen\w+|process\w+|hospedad?\w*|mantid\w+|compartilhad?\w*|enviad\w+|localizad\w+|servidor\w*|tratad\w+|acess\w+)"
REQUIREMENT_RULES = {
    "finalidade": {
        "yes": [_LINK + r"[^.;]{0,70}" + _ACTIVITY],
        "no": [
            r"melhorar (?:sua|a) experiencia|otimizar? (?:sua|a) experiencia|melhorar (?:os )?(?:nossos )?servicos|fins previstos nesta|finalidades legitimas"
            r"|conforme a legislacao|melhor experiencia"
        ],
    },
    "direitos_titular": {
        "yes": [
            r"confirma\w*[^.;]{0,40}(?:existencia|tratament)", r"(?:acess\w+|obter (?:copia|uma copia))[^.;]{0,30}(?:dados|informac)",
            r"(?:corrig\w+|retific\w+|atualiz\w+)[^.;]{0,40}(?:dados|incomplet|inexat|desatualiz)", r"(?:anonimiz\w+|bloque\w+)[^.;]{0,40}(?:dados|desnecessari|excessiv)",
            r"portabilidade", r"transferir[^.;]{0,40}(?:outro fornecedor|outro servico)", r"(?:elimin\w+|exclu\w+|apagar)[^.;]{0,50}(?:dados|consentiment)",
            r"(?:saber|informac\w+|conhecer)[^.;]{0,50}(?:com quem|entidades|compartilha)", r"nao (?:fornecer|consentir)[^.;]{0,40}consequencia",
            r"revoga\w+[^.;]{0,30}consentiment", r"retirar[^.;]{0,30}consentiment", r"revis\w+[^.;]{0,40}decis[^.;]{0,40}automatizad", r"peticion\w+",
        ],
        "no": [],
    },
    "transf_internacional": {
        "yes": [_HANDLING + r"[^.;]{0,80}" + _ABROAD, _ABROAD + r"[^.;]{0,60}" + _HANDLING, r"transferencia internacional"],
        "no": [r"uso compartilhado de dados\s*:|comunicacao, difusao, transferencia", r"nao (?:ha|ocorre|realiza\w*|efetua\w*|existe|havera|havendo)[^.;]{0,60}transfer"],
    },
}
