"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level
tags.  Every block is a vector: hashed tags, class and id words on its path,
hashed words (all of them), and a few shares.  A bidirectional LSTM in numpy reads the whole
sequence and labels each block with the document as context, so the same
paragraph counts as article text or as a reader's comment by where it stands.
The labeller is trained on generated pages whose labels are known (layouts of
menus, headers, notices, adverts, forms, sidebars, comments and footers around
articles, two in five of them without any telling tag, class or id word; kinds
draw their words from vocabularies of their own), with a fixed seed, on the driver: ``TRAIN_PAGES`` pages whatever the
input.  Labelling runs in ``mapInArrow``; nothing is shuffled.

Defined results: null and empty html give empty text; character references are
decoded; scripts, styles, heads, comments and a tag cut off at the end are
markup; white space inside a block, line breaks by tag too, becomes one space;
repeated pages are labelled one by one; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from html.parser import HTMLParser
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TRAIN_PAGES = 700
PATH, WORDS, SHARES, HIDDEN = 256, 256, 10, 20
CELLS = 1 << 15
#: Share of the rate by which the weights of words shrink in a step of training.
DECAY = 2.0
#: Elements that end a block of text, by HTML's rules.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td
textarea tfoot th thead tr ul""".split())
#: Elements without content, and elements whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style noscript template svg iframe object title".split())
#: A start tag on the left closes these if open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          **{t: {"p"} for t in """address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main
          menu nav ol p pre section table ul""".split()}}
#: Elements that a closing rule does not look beyond.
FENCES = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())
_space = re.compile(r"\s+")
_cut_tag = re.compile(r"<(?:[A-Za-z/!?][^<>]*)?\Z")
_name = re.compile(r"[a-z0-9]+")


class _Leaves(HTMLParser):
    """Collects ``(path tokens, text, characters inside links)`` of all blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[tuple, str, int]] = []
        self.stack: list[tuple[str, tuple]] = []
        self.parts: list[str] = []
        self.linked = self.links = self.unseen = 0

    def flush(self) -> None:
        if self.parts:
            text = _space.sub(" ", "".join(self.parts)).strip()
            if text:
                path = [t for _, tokens in self.stack for t in tokens]
                tags = [t for t, _ in self.stack if t in BLOCKS]
                path += [f"leaf:{t}" for t in tags[-1:]] + [f"over:{t}" for t in tags[-2:-1]]
                self.blocks.append((tuple(path), text, self.linked))
            self.parts, self.linked = [], 0

    def _pop(self, to: int) -> None:
        for tag, _ in self.stack[to:]:
            self.links -= tag == "a"
            self.unseen -= tag in UNSEEN
        del self.stack[to:]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "body":
            for i, (t, _) in enumerate(self.stack):
                if t == "head":
                    self._pop(i)
                    break
        closes = CLOSES.get(tag)
        if closes:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in closes:
                    self._pop(i)
                    break
                if self.stack[i][0] in FENCES:
                    break
        if tag in VOID:
            return
        tokens = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                tokens += [f".{w}" for w in _name.findall(value.lower())]
            elif key == "hidden":
                tokens.append(".hidden")
        self.stack.append((tag, tuple(tokens)))
        self.links += tag == "a"
        self.unseen += tag in UNSEEN

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                break

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def leaves(html: str | None) -> list[tuple[tuple, str, int]]:
    """Blocks of a page in order."""
    if not html:
        return []
    reader = _Leaves()
    reader.feed(_cut_tag.sub("", html))
    reader.close()
    reader.flush()
    return reader.blocks


_slots: dict[str, tuple[int, float]] = {}


def _slot(token: str, size: int) -> tuple[int, float]:
    """Place and sign of a token in a hashed vector."""
    if len(_slots) > 200_000:
        _slots.clear()
    key = f"{size}{token}"
    if key not in _slots:
        h = zlib.crc32(key.encode("utf-8", "replace"))
        _slots[key] = ((h >> 1) % size, 1.0 if h & 1 else -1.0)
    return _slots[key]


_paths: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _path(path: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Places and sums of signs of all distinct tokens of a path, remembered."""
    if path not in _paths:
        if len(_paths) > 20_000:
            _paths.clear()
        slots: dict[int, float] = {}
        for t in dict.fromkeys(path):
            k, sign = _slot(t, PATH)
            slots[k] = slots.get(k, 0.0) + sign
        _paths[path] = np.fromiter(slots, np.int64, len(slots)), np.fromiter(slots.values(), np.float32, len(slots))
    return _paths[path]


class _Words(dict):
    """Place of a word in the two halves (plus and minus) of a hashed vector, remembered; one place more for bare punctuation."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        bare = word.lower().strip(_edges)
        self[word] = k = zlib.crc32(bare.encode("utf-8", "replace")) % (2 * WORDS) if bare else 2 * WORDS
        return k


_edges = ".,;:!?\"'()[]{}<>|/\\#$%&*+=~^_-–—•·…«»“”„"
_words = _Words()


def vectors(blocks: list[tuple[tuple, str, int]]) -> np.ndarray:
    """One vector per block."""
    out = np.zeros((len(blocks), PATH + WORDS + SHARES), np.float32)
    last = max(1, len(blocks) - 1)
    places, counts, shares = [], [], []
    for i, (path, text, linked) in enumerate(blocks):
        at, signs = _path(path)
        out[i, at] = signs
        words = text.split()
        n, m = len(words), len(text)
        places += map(_words.__getitem__, words)
        counts.append(n)
        marks = text.count(".") + text.count(",") + text.count(";") + text.count(":") + text.count("!") + text.count("?")
        shares.append((
            log1p(n) / 4, min(1.0, linked / m), min(1.0, 10 * marks / m), m / n / 10, text[-1] in ".!?…\"'”", n <= 3,
            "©" in text or "opyright" in text, i / last, text[0].isupper(), 1.0))
    if blocks:
        n = np.array(counts)
        size = 2 * WORDS + 1
        held = np.bincount(np.repeat(np.arange(len(n)) * size, n) + places, minlength=len(n) * size).reshape(len(n), size)
        held = (held[:, :WORDS] - held[:, WORDS:-1]).astype(np.float32)
        out[:, PATH:PATH + WORDS] = held / np.maximum(1, np.sqrt((held * held).sum(1)))[:, None]
        out[:, PATH + WORDS:] = shares
    return out


class Labeller:
    """Bidirectional LSTM with one output per block."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        d, h = PATH + WORDS + SHARES, HIDDEN
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for way in "fb":
            bias = np.zeros(4 * h, np.float32)
            bias[h:2 * h] = 1
            self.p |= {f"W{way}": make(d, 4 * h), f"U{way}": make(h, 4 * h), f"B{way}": bias}
        self.p |= {"V": make(2 * h, 1), "c": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool):
        steps = range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1)
        n, h = x.shape[0], HIDDEN
        pre = x @ self.p[f"W{way}"] + self.p[f"B{way}"]
        hidden, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, tape = np.zeros((n, x.shape[1], h), np.float32), []
        for t in steps:
            a = pre[:, t] + hidden @ self.p[f"U{way}"]
            gates = 1 / (1 + np.exp(-a[:, :3 * h]))
            i, f, o, g = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:], np.tanh(a[:, 3 * h:])
            new = f * cell + i * g
            squashed = np.tanh(new)
            m = mask[:, t:t + 1]
            if keep:
                tape.append((t, hidden, cell, i, f, o, g, squashed, m))
            cell, hidden = m * new + (1 - m) * cell, m * (o * squashed) + (1 - m) * hidden
            out[:, t] = hidden
        return out, tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log-odds of article text for every block of padded pages."""
        both = np.concatenate([self._run(x, mask, w, False)[0] for w in "fb"], axis=2)
        return (both @ self.p["V"])[..., 0] + self.p["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h = HIDDEN
        runs = {w: self._run(x, mask, w, True) for w in "fb"}
        both = np.concatenate([runs[w][0] for w in "fb"], axis=2)
        z = (both @ self.p["V"])[..., 0] + self.p["c"]
        dz = ((1 / (1 + np.exp(-z)) - y) * mask / mask.sum()).astype(np.float32)
        grad = {"V": (both * dz[..., None]).sum((0, 1))[:, None], "c": np.array([dz.sum()], np.float32)}
        for k, way in enumerate("fb"):
            dout = dz[..., None] * self.p["V"][k * h:(k + 1) * h, 0]
            dh, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            dpre, dU = np.zeros((*x.shape[:2], 4 * h), np.float32), np.zeros((h, 4 * h), np.float32)
            for t, hidden, cell, i, f, o, g, squashed, m in reversed(runs[way][1]):
                dh = dh + dout[:, t]
                own, dcell = dh * m, dc * m
                dcell = dcell + own * o * (1 - squashed ** 2)
                da = np.concatenate([dcell * g * i * (1 - i), dcell * cell * f * (1 - f), own * squashed * o * (1 - o), dcell * i * (1 - g ** 2)], axis=1)
                dpre[:, t] = da
                dU += hidden.T @ da
                dh, dc = dh * (1 - m) + da @ self.p[f"U{way}"].T, dc * (1 - m) + dcell * f
            flat = dpre.reshape(-1, 4 * h)
            grad |= {f"W{way}": x.reshape(-1, x.shape[2]).T @ flat, f"U{way}": dU, f"B{way}": flat.sum(0)}
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], *, epochs: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on log loss, batches of pages of like length, the rate falling to nothing."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        order = np.argsort([len(x) for x, _ in pages], kind="stable")
        groups = [order[i:i + batch] for i in range(0, len(order), batch)]
        for _ in range(epochs):
            for at in rng.permutation(len(groups)):
                x, mask = padded([pages[i][0] for i in groups[at]])
                y = padded([pages[i][1][:, None] for i in groups[at]])[0][..., 0]
                step += 1
                now = rate * (1 - (step - 1) / (epochs * len(groups)))
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - now * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)
                    if k[0] == "W":  # words seen once are not learnt by heart
                        self.p[k][PATH:PATH + WORDS] *= 1 - DECAY * now


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(r) for r in rows)
    x, mask = np.zeros((len(rows), longest, rows[0].shape[1]), np.float32), np.zeros((len(rows), longest), np.float32)
    for i, r in enumerate(rows):
        x[i, :len(r)], mask[i, :len(r)] = r, 1
    return x, mask


MARK = ""
#: Class and id words of the generated layouts, by kind of block.
KINDS = {
    "menu": ("nav menu navbar navigation topbar breadcrumbs breadcrumb tabs links", "nav"),
    "header": ("header masthead site-header branding logo banner-top", "header"),
    "notice": ("cookie cookies consent notice alert gdpr newsletter subscribe popup modal", "div"),
    "advert": ("ad ads advert advertisement sponsored promo banner adbox ad-slot", "div"),
    "sidebar": ("sidebar aside related widget trending popular recommended more-stories", "aside"),
    "form": ("search login signup contact form search-form", "form"),
    "comments": ("comments comment replies discussion responses comment-list", "section"),
    "footer": ("footer site-footer copyright bottom legal colophon", "footer"),
}
#: Words that the generated texts of a kind draw from, by language; ``any`` and ``article`` serve articles, ``any`` serves all.
VOCABULARY = {
    "en": {
        "any": "the of and to in a is that for it with as was on be at by this from are or an not you your all more we our can will have has",
        "article": """year people government city water war president company market research study country president report history century team season
            river house family school children doctor scientists court law police minister party election economy prices according said told described
            found began became during after between several among across early later former local national public large small long new old north south""",
        "menu": "home about news sports business politics world opinion archive shop blog gallery events products services support help faq contact language",
        "header": "welcome official site online daily magazine your since edition today menu brand slogan the trusted source established",
        "notice": """cookies cookie consent privacy policy accept agree settings preferences browser continue website experience personalise third-party
            subscribe newsletter sign inbox unsubscribe javascript enable disclaimer notice gdpr data partners""",
        "advert": """sponsored advertisement buy now save offer deal discount free shipping order today limited sale price click here shop cart guaranteed
            best cheap off exclusive trial win promo coupon download casino loan insurance""",
        "sidebar": "related popular trending latest recommended read also stories posts most viewed editors picks archives tags categories follow us next previous",
        "form": "search email password username login register submit send name address forgot remember sign up reset enter required",
        "comments": """comment comments reply posted ago says wrote thanks lol agree disagree great post author i think you're wrong guys report flag like upvote
            anonymous guest commented thread moderator edited permalink awesome sharing my me""",
        "footer": "copyright rights reserved terms privacy policy contact imprint sitemap powered cookies legal trademarks inc ltd conditions use accessibility careers",
    },
    "de": {
        "any": "der die das und in zu den von mit ist auf für nicht ein eine sich des dem auch als es an werden aus bei wir sie ihre",
        "article": "jahr menschen regierung stadt wasser krieg unternehmen forschung studie land geschichte jahrhundert fluss haus familie schule gericht gesetz polizei "
                   "minister partei wahl wirtschaft sagte berichtete wurde während nach zwischen mehrere früher später",
        "menu": "startseite über nachrichten sport wirtschaft politik meinung archiv laden hilfe kontakt produkte",
        "header": "willkommen offizielle seite zeitung ausgabe heute seit",
        "notice": "cookies einwilligung datenschutz akzeptieren zustimmen einstellungen browser webseite newsletter abonnieren abmelden hinweis partner",
        "advert": "anzeige werbung kaufen jetzt sparen angebot rabatt gratis versand bestellen preis klicken günstig gutschein kredit versicherung",
        "sidebar": "verwandte beliebt meistgelesen neueste empfohlen lesen artikel beiträge schlagworte kategorien folgen",
        "form": "suche suchen passwort benutzername anmelden registrieren absenden name adresse vergessen",
        "comments": "kommentar kommentare antworten schrieb danke finde meine ich du toll beitrag melden gast verfasst uhr",
        "footer": "urheberrecht rechte vorbehalten impressum datenschutz agb kontakt nutzungsbedingungen gmbh barrierefreiheit",
    },
    "fr": {
        "any": "le la les de des et un une en est que pour dans du au sur il pas par avec plus nous vous votre se sont",
        "article": "année gens gouvernement ville eau guerre président entreprise recherche étude pays histoire siècle rivière maison famille école tribunal loi "
                   "police ministre parti élection économie selon déclaré pendant après entre plusieurs",
        "menu": "accueil actualités sport économie politique opinion archives boutique aide contact produits",
        "header": "bienvenue site officiel journal édition depuis quotidien",
        "notice": "cookies consentement confidentialité accepter paramètres navigateur site newsletter abonner désabonner avis partenaires",
        "advert": "publicité sponsorisé acheter maintenant offre promotion réduction gratuit livraison commander prix cliquez crédit assurance",
        "sidebar": "articles liés populaires récents recommandés lire aussi catégories étiquettes suivez",
        "form": "recherche rechercher mot passe identifiant connexion inscription envoyer nom adresse oublié",
        "comments": "commentaire commentaires répondre écrit merci je mon avis super signaler invité posté",
        "footer": "droits réservés mentions légales conditions utilisation confidentialité contact plan accessibilité",
    },
    "es": {
        "any": "el la los de y en un una que es por con para del se las al no su más lo como nos usted",
        "article": "año gente gobierno ciudad agua guerra presidente empresa investigación estudio país historia siglo río casa familia escuela tribunal ley "
                   "policía ministro partido elección economía según dijo durante después entre varios",
        "menu": "inicio noticias deportes economía política opinión archivo tienda ayuda contacto productos",
        "header": "bienvenidos sitio oficial diario edición desde",
        "notice": "cookies consentimiento privacidad aceptar configuración navegador sitio boletín suscribirse aviso socios",
        "advert": "publicidad patrocinado comprar ahora oferta descuento gratis envío pedir precio clic préstamo seguro",
        "sidebar": "relacionados populares recientes recomendados leer también categorías etiquetas síguenos",
        "form": "buscar contraseña usuario entrar registrarse enviar nombre dirección olvidó",
        "comments": "comentario comentarios responder escribió gracias yo creo genial denunciar invitado publicado",
        "footer": "derechos reservados aviso legal términos condiciones privacidad contacto mapa accesibilidad",
    },
}
VOCABULARY = {lang: {kind: words.split() for kind, words in kinds.items()} for lang, kinds in VOCABULARY.items()}
#: Names of looks, which tell nothing of the kind of a block.
LOOKS = """flex flex-col flex-row w-full h-full mt-4 mb-2 px-2 py-1 mx-auto text-sm text-lg font-bold bg-white border rounded shadow grid gap-4 col-6 row
container wrapper block inline items-center justify-between max-w-4xl relative absolute z-10 p-4 m-0 leading-6 tracking-wide dark hover clearfix""".split()
ARTICLES = "article content main post entry story article-body post-content entry-content page text"


def made_page(rng: np.random.Generator, layout: str | None = None) -> str:
    """A page of a random layout; blocks that are not article text start with ``MARK``.

    A page is ``marked``; or ``plain``, without class or id words and telling
    tags; or ``flat``, where moreover every kind is prose in paragraphs, so that
    only words tell them apart.  Words come from ``VOCABULARY`` or, on some
    marked pages, are random letters throughout.
    """
    letters = "etaoinshrdlucmfwypvbgkéüñ"
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    layout = layout or pick(["marked", "marked", "marked", "plain", "flat"])
    plain = layout != "marked"
    spoken = VOCABULARY[pick(["en", "en", *VOCABULARY])]
    strange = rng.uniform(0, 0.3) if plain else 1 if chance(0.5) else rng.uniform(0, 0.9)
    kind = "article"

    def word() -> str:
        if chance(strange):
            return "".join(letters[int(i)] for i in rng.integers(0, len(letters), int(rng.integers(2, 11))))
        r = rng.random()
        return pick(spoken["any" if r < 0.45 else kind if r < 0.92 else "article" if r < 0.98 else pick(list(KINDS))])

    def sentence(lo: int, hi: int) -> str:
        return (" ".join(word() for _ in range(int(rng.integers(lo, hi))))).capitalize() + pick([".", ".", ".", "?", "!", ""])

    prose = lambda n: " ".join(sentence(2, 18) for _ in range(max(1, n)))
    linked = lambda s: f'<a href="/{word()}">{s}</a>'

    def wrap(kind: str, inner: str) -> str:
        names, tag = KINDS[kind]
        if plain:
            return f"<div>{inner}</div>" if layout == "plain" else inner
        style = pick(["tag", "class", "id", "both"]) if kind not in ("notice", "advert") else pick(["class", "id"])
        name = pick(names.split())
        if style == "tag":
            return f"<{tag}>{inner}</{tag}>"
        if style == "both":
            return f'<{tag} class="{name}">{inner}</{tag}>'
        return f'<{pick(["div", "div", "section"])} {style}="{name}">{inner}</div>'.replace("<section", "<div")

    def junk(own: str) -> str:
        nonlocal kind
        kind, outer = own, kind
        try:
            return made_junk(kind)
        finally:
            kind = outer

    def made_junk(kind: str) -> str:
        if layout == "flat":
            return "".join(f"<p>{MARK}{prose(int(rng.integers(1, 9)))}</p>" for _ in range(int(rng.integers(1, 4))))
        short = lambda: MARK + (word() if chance(0.6) else sentence(1, 5))
        if kind == "menu":
            items = [linked(short()) for _ in range(int(rng.integers(2, 9)))]
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if chance(0.75) else "".join(f"<div>{x}</div>" for x in items)
        elif kind == "header":
            inner = f"<{(t := pick(['h1', 'h2', 'div', 'p']))}>{short()}</{t}>" + (f"<p>{MARK}{sentence(2, 8)}</p>" if chance(0.5) else "")
        elif kind in ("notice", "advert"):
            body = MARK + prose(int(rng.integers(1, 4)))
            inner = body if chance(0.6) else f"<p>{body}</p>" + (f"<button>{short()}</button>" if chance(0.5) else "")
        elif kind == "sidebar":
            inner = f"<h3>{short()}</h3>" + ("<ul>" + "".join(f"<li>{linked(MARK + sentence(2, 9))}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>"
                                             if chance(0.6) else "".join(f"<p>{MARK}{prose(int(rng.integers(1, 3)))}</p>" for _ in range(int(rng.integers(1, 4)))))
        elif kind == "form":
            inner = f'<label>{short()}</label><input name="q">' + (f"<select><option>{short()}<option>{short()}</select>" if chance(0.3) else "") + f"<button>{short()}</button>"
            return f'<form class="{pick(KINDS["form"][0].split())}">{inner}</form>' if chance(0.5) and not plain else f"<form>{inner}</form>"
        elif kind == "comments":
            one = lambda: (f"<h4>{short()}</h4>" if chance(0.5) else "") + f"<p>{MARK}{prose(int(rng.integers(1, 5)))}</p>"
            inner = (f"<h3>{short()}</h3>" if chance(0.5) else "") + "".join(
                f'<div class="comment">{one()}</div>' if chance(0.5) and not plain else one() for _ in range(int(rng.integers(1, 6))))
        else:
            inner = MARK + pick(["&copy; ", "", "Copyright "]) + word() + pick([".example.com", ""]) + pick([" &middot; ", " | ", " "]) + prose(int(rng.integers(1, 3)))
            inner = inner if chance(0.6) else f"<p>{inner}</p>"
        return wrap(kind, inner)

    def article() -> str:
        out = [f"<h1>{sentence(1, 9)}</h1>"] if chance(0.85) else []
        count = int(rng.integers(0, 5)) if chance(0.3) else int(rng.integers(2, 14))
        for _ in range(count):
            r = rng.random()
            body = prose(int(rng.integers(1, 9))) if chance(0.75) else sentence(1, 8)
            if r < 0.62:
                out.append(f"<p>{body}</p>")
            elif r < 0.72:
                out.append(f"<p><b>{body}<br>")
            elif r < 0.77:
                out.append(f"<h{(k := int(rng.integers(2, 4)))}>{sentence(1, 7)}</h{k}>")
            elif r < 0.81:
                out.append("<ul>" + "".join(f"<li>{sentence(2, 14)}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>")
            elif r < 0.84:
                out.append(f"<blockquote>{body}</blockquote>")
            elif r < 0.87:
                out.append(f"<p>{linked(word())} {body}</p>")
            elif r < 0.90:
                out.append(f"<div>{body}</div>")
            elif r < 0.96 and len(out) > 1:
                out.append(junk(pick(["advert", "sidebar", "notice"])))
            else:
                out.append(f"<p>{body}")
        if layout == "flat":
            out = [junk("advert") if chance(0.12) else f"<p>{prose(int(rng.integers(1, 9)))}</p>" for _ in range(max(1, count))]
            return "".join(out)
        inner = "".join(out) or f"<p>{prose(2)}</p>"
        style = 1 if plain else rng.random()
        if style < 0.45:
            return f"<article>{inner}</article>"
        if style < 0.6:
            return f"<main>{inner}</main>"
        if style < 0.92:
            return f'<div {pick(["class", "id"])}="{pick(ARTICLES.split())}">{inner}</div>'
        return f"<div>{inner}</div>"

    def styled(page: str) -> str:
        """Names of looks around the telling names of a page, as utility style sheets have them."""
        def more(m):
            left, right = ([pick(LOOKS) for _ in range(int(rng.integers(0, 9)))] for _ in range(2))
            return f'{m[1]}="{" ".join([*left, m[2], *right])}"'
        return re.sub(r'\b(class|id)="([^"]*)"', more, re.sub(r"<(div|p|ul|li|h[1-4]|section|article)>", lambda m: f'<{m[1]} class="">' if chance(0.4) else m[0], page))

    some = lambda kinds, p: [junk(k) for k in kinds if chance(p)]
    top = some(["notice", "header", "menu", "form", "advert"], 0.45)
    if chance(0.5):
        top = [junk("menu"), junk("advert")]
    rng.shuffle(top)
    bottom = some(["sidebar", "advert", "comments", "form", "menu"], 0.35)
    middle = [junk("sidebar")] if chance(0.15) else []
    end = [junk("footer")] if chance(0.85) else []
    page = "<html><head><title>x</title></head><body>" + "".join([*top, *middle, article(), *bottom, *end]) + "</body></html>"
    page = styled(page) if chance(0.25) else page
    return page[:int(len(page) * rng.uniform(0.5, 1))] if chance(0.15) else page


def made_examples(n: int, seed: int, layout: str | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of generated pages."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        blocks = leaves(made_page(rng, layout))
        y = np.array([MARK not in text for _, text, _ in blocks], np.float32)
        clean = [(path, text.replace(MARK, "").strip() or "x", linked) for path, text, linked in blocks]
        if blocks:
            out.append((vectors(clean), y))
    return out


def trained(pages: int = TRAIN_PAGES, seed: int = 3) -> Labeller:
    model = Labeller()
    model.fit(made_examples(pages, seed))
    return model


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    """Main text of every page; pages of like length are labelled together."""
    parsed = [leaves(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(parsed) if b), key=lambda i: len(parsed[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(parsed[order[to]]) <= CELLS:
            to += 1
        score = model.scores(*padded([vectors(parsed[i]) for i in order[at:to]]))
        for k, i in enumerate(order[at:to]):
            out[i] = "\n".join(text for (_, text, _), s in zip(parsed[i], score[k]) if s > 0)
        at = to
    return out


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = main_texts(sent.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)
