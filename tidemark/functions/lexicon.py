"""Word lists, maps and curves that results depend on."""

from __future__ import annotations

LANGUAGES = ("en", "fr", "de", "es")

# Stop words of the language vote and of clustering, by language.
STOP_WORDS = {
    "en": "the a an of in on at to for by with and or but is are was were be been being has have had do does did will would can could should may might must this that these those i you he she it we they".split(),
    "fr": "le la les un une des de du à au aux en dans sur sous pour par avec sans et ou mais est sont était étaient être a ont avait avoir ce cette ces je tu il elle nous vous ils elles".split(),
    "de": "der die das den dem ein eine einen einem einer eines und oder aber in an auf bei mit von zu für ist sind war waren sein hat haben hatte hatten ich du er sie es wir ihr".split(),
    "es": "el la los las un una unos unas de del en a al por para con sin sobre y o pero es son era eran ser ha han había habían haber esto esta este estos estas yo tú él ella nosotros vosotros ellos ellas".split(),
}

# Intent markers by language and intent, in order.
INTENT_MARKERS = {
    "en": {
        "transactional": "buy,purchase,order,find,near me,deal,deals,discount,sale,price,prices,cheap,cheapest,free shipping,in stock".split(","),
        "commercial": "best,top,vs,versus,review,reviews,comparison,compare,alternative,alternatives,pros and cons".split(","),
        "informational": "what,how,why,when,where,who,which,guide,tutorial,learn,meaning,definition,examples".split(","),
        "navigational": "login,log in,sign in,account,support,help,contact,careers".split(","),
    },
    "fr": {
        "transactional": "acheter,achat,commander,où acheter,prix,pas cher,soldes,réduction,livraison gratuite,en stock".split(","),
        "commercial": "meilleur,meilleurs,top,contre,vs,avis,comparaison,comparer,alternative".split(","),
        "informational": "quoi,comment,pourquoi,quand,où,qui,quel,quelle,guide,tutoriel,apprendre,signification,définition,exemples".split(","),
        "navigational": "connexion,se connecter,compte,support,aide,contact,carrières".split(","),
    },
    "de": {
        "transactional": "kaufen,bestellen,wo kaufen,preis,preise,günstig,billig,rabatt,angebot,kostenloser versand,auf lager".split(","),
        "commercial": "bester,beste,top,gegen,vs,test,tests,bewertung,vergleich,alternative".split(","),
        "informational": "was,wie,warum,wann,wo,wer,welche,welcher,anleitung,tutorial,lernen,bedeutung,definition,beispiele".split(","),
        "navigational": "anmeldung,anmelden,einloggen,konto,support,hilfe,kontakt,karriere".split(","),
    },
    "es": {
        "transactional": "comprar,compra,pedir,dónde comprar,precio,barato,ofertas,descuento,envío gratis,en stock".split(","),
        "commercial": "mejor,mejores,top,contra,vs,reseña,opinión,comparación,comparar,alternativa".split(","),
        "informational": "qué,cómo,por qué,cuándo,dónde,quién,cuál,guía,tutorial,aprender,significado,definición,ejemplos".split(","),
        "navigational": "iniciar sesión,conexión,cuenta,soporte,ayuda,contacto,carreras".split(","),
    },
}

# Question pronouns by language.
QUESTION_PRONOUNS = {
    "en": "what how why when where who which whose".split(),
    "fr": "quoi comment pourquoi quand où qui quel quelle quels quelles".split(),
    "de": "was wie warum wann wo wer welche welcher welches".split(),
    "es": "qué,cómo,por qué,cuándo,dónde,quién,cuál,cuáles".split(","),
}

# Letters that only some languages have.
LANGUAGE_CHARS = {"fr": "àâäçéèêëîïôûùüÿœæ", "de": "äöüß", "es": "ñáéíóúü¿¡"}

# Names of result-page features.
SERP_FEATURES = {
    "featured snippet": "featured_snippet", "people also ask": "paa", "paa": "paa", "ai overview": "ai_overview", "ai_overview": "ai_overview", "knowledge panel": "knowledge_panel",
    "local pack": "local_pack", "shopping": "shopping", "images": "images", "video": "video", "videos": "video", "news": "news", "sitelinks": "sitelinks",
}

# How far each source is trusted.
SOURCE_RELIABILITY = {"gsc": 1.0, "semrush": 0.9, "ahrefs": 0.9, "moz": 0.9, "ubersuggest": 0.75, "generic": 0.7, "seed": 0.5}

# Column names of each tool's export, lower case, and the field each fills.
TOOL_COLUMNS = {
    "semrush": {
        "keyword": "keyword", "volume": "volume", "search volume": "volume", "keyword difficulty": "difficulty", "kd%": "difficulty", "kd": "difficulty", "cpc": "cpc", "cpc (usd)": "cpc",
        "position": "position", "pos.": "position", "serp features by keyword": "serp_features", "serp features": "serp_features", "traffic": "traffic_potential", "intent": "intent_label_raw",
        "country": "country", "parent topic": "parent_topic", "url": "competitor_url",
    },
    "ahrefs": {
        "keyword": "keyword", "volume": "volume", "kd": "difficulty", "cpc": "cpc", "current position": "position", "position": "position", "serp features": "serp_features",
        "traffic potential (tp)": "traffic_potential", "intents": "intent_label_raw", "country": "country", "parent topic": "parent_topic", "top url": "competitor_url", "url": "competitor_url",
        "dr": "domain_rank", "clicks": "clicks",
    },
    "gsc": {"top queries": "keyword", "query": "keyword", "clicks": "clicks", "impressions": "impressions", "ctr": "ctr", "position": "position", "country": "country"},
    "moz": {"keyword": "keyword", "monthly volume": "volume", "volume": "volume", "difficulty": "difficulty", "organic ctr": "ctr", "serp features": "serp_features", "country": "country"},
    "ubersuggest": {"keyword": "keyword", "volume": "volume", "search volume": "volume", "seo difficulty": "difficulty", "sd": "difficulty", "cpc": "cpc"},
    "generic": {"keyword": "keyword", "volume": "volume", "vol": "volume", "monthly searches": "volume", "difficulty": "difficulty", "kd": "difficulty", "cpc": "cpc", "position": "position"},
}
# Headers that tell a tool, in order of trial.
TOOL_SIGNATURES = (
    ("semrush", {"keyword difficulty", "serp features by keyword"}), ("semrush", {"kd%", "parent topic"}), ("ahrefs", {"kd", "traffic potential (tp)"}), ("ahrefs", {"current position", "intents"}),
    ("gsc", {"top queries", "impressions"}), ("gsc", {"query", "ctr", "impressions"}), ("moz", {"monthly volume", "organic ctr"}), ("ubersuggest", {"seo difficulty"}),
)

# Substrings of the modality, temporal and season tests.
VOICE = ("near me", "please", "ok google")
CONVERSATION = ("can you", "tell me about", "how do i")
GEO_CONVERSATION = (*CONVERSATION, "what is the best")
SEASONS = ("christmas", "black friday", "easter", "summer", "winter", "spring", "autumn")
SEASONAL = (*SEASONS, "halloween", "thanksgiving", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
HOW_TO = ("how to", "comment", "wie", "cómo", "vs", "versus")

# Intents in order of preference, their funnel stages, and scores by use.
INTENTS = ("informational", "navigational", "transactional", "commercial_investigation")
FUNNEL = {"informational": "awareness", "navigational": "consideration", "commercial_investigation": "consideration", "transactional": "decision"}
INTENT_SCORE = {
    "main": {"commercial_investigation": 100, "transactional": 100, "informational": 80, "navigational": 60},
    "quick_win": {"commercial_investigation": 100, "transactional": 80, "informational": 70, "navigational": 0},
    "aeo": {"navigational": 100, "informational": 70, "commercial_investigation": 50, "transactional": 30},
}

# Suffixes that the light stemmer strips, in order.
STEM_SUFFIXES = {"en": "ies es s ed ing er est".split(), "fr": "ent es s e".split(), "de": "en er es e".split(), "es": "es as os s".split()}

# Stop words of entity extraction, by language.
ENTITY_STOPS = {
    "en": "a an the this that these those of in on at to from by for with without about into over under again further then once and or but nor so as is are was were be been being do does did has have had i you he she it we they me him her them my your his its our their what which who whom how when where why whether if not no yes than too very can will just don should now vs versus".split(),
    "fr": "le la les un une des du de au aux et ou mais donc ni car a dans sur sous par pour avec sans ce cet cette ces mon ton son notre votre leur je tu il elle nous vous ils elles que qui quoi comment quand pourquoi ne pas plus est sont etre avoir".split(),
    "de": "der die das ein eine den dem des und oder aber doch als wie wenn weil dass in an auf zu von mit ohne fur uber unter ich du er sie es wir ihr was wer wann wo warum nicht kein ist sind sein haben werden".split(),
    "es": "el la los las un una unos unas de del al y o pero ni porque que como cuando donde por para con sin en sobre bajo este esta estos estas mi tu su nuestro vuestro yo ella nosotros quien no si es son ser haber muy mas".split(),
    "it": "il lo la gli le un uno una di del dello della dei degli delle da dal dallo dalla dai dagli dalle in nel nello nella nei negli nelle con col coi su sul sullo sulla sui sugli sulle per tra fra ed od ma anche se che chi come dove quando perché perche più piu meno molto poco questo questa questi queste quello quella quelli quelle mio mia tuo tua suo sua nostro vostro loro non ci si ne già gia ancora senza sotto sopra contro sono ho hai ha hanno essere avere vs versus".split(),
}

# Click-through rate by rank, with its provenance.
CTR = {
    1: 0.285, 2: 0.157, 3: 0.11, 4: 0.08902, 5: 0.07204, 6: 0.05829, 7: 0.04717, 8: 0.03818, 9: 0.03089, 10: 0.025,
    11: 0.02023, 12: 0.01637, 13: 0.01325, 14: 0.01072, 15: 0.00868, 16: 0.00702, 17: 0.00568, 18: 0.0046, 19: 0.00372, 20: 0.00301,
}
CTR_CONFIRMED, CTR_MEASURED_TO = (1, 2, 3, 10), 10
CLICK_FACTORS = {"featured_snippet": 0.8175, "shopping": 0.4807, "knowledge_panel": 0.586}
AI_MULTIPLIER, AI_RECOVERY = 0.39, 1.35
UNCERTAINTY = {"confirmed": 0.0, "interpolated": 0.15, "extrapolated": 0.25, "unranked": 0.25}
DEMAND_FACTORS = {"rising": (1.0, 1.15), "seasonal": (1.0, 1.05), "declining": (0.85, 0.85), "flat": (1.0, 1.0)}
READINESS_WEIGHTS = {"eligibility": 0.28, "query_family": 0.24, "entity_coverage": 0.20, "extractability": 0.14, "structured_demand": 0.09, "freshness": 0.05}
FRESHNESS = {"rising": 1.0, "seasonal": 0.8, "declining": 0.4, "flat": 0.3}

# Synonyms of single words.
SYNONYMS = {
    "best": ["top", "leading"], "top": ["best"], "cheap": ["affordable", "budget"], "affordable": ["cheap", "budget"], "budget": ["affordable", "cheap"], "buy": ["purchase", "shop"],
    "review": ["reviews", "rating"], "reviews": ["review", "ratings"], "guide": ["tutorial"], "vs": ["versus"], "women": ["womens", "female"], "men": ["mens", "male"],
}

# Italian words, suffixes, letters and markers of the language correction.
IT_DIACRITICS, IT_FOREIGN_LETTERS, IT_FOREIGN = "àèéìíîòóùú", "jkwxy", ("oo",)
IT_VOWELS = "aeiou" + IT_DIACRITICS
IT_SUFFIXES = "zione zioni mento menti tura ture aggio aggi ezza ezze eria erie anza anze enza enze atore atori atrice atrici abile abili ibile ibili ista iste isti ario aria arie oso osa osi ose ale ali ile ivo iva ive ico ica ici iche".split()
IT_CUES = (
    "il lo la le gli un uno una di del dello della dei degli delle da dal dallo dalla dai dagli dalle nel nello nella nei negli nelle sul sullo sulla sui sugli sulle col coi per tra fra con su in "
    "che chi come dove quando perché perche quale quali quanto quanti quante cosa più piu meno molto anche senza sotto sopra questo questa questi queste quello quella quelli quelle mio mia tuo tua suo sua "
    "nostro vostro loro sono essere avere hanno prezzo prezzi costo comprare compra acquistare acquisto offerta offerte sconto sconti vendita spedizione economico migliori migliore recensione recensioni "
    "confronto paragone alternativa alternative opinioni guida significato scegliere differenza differenze esempi esempio tutorial accedi accesso registrati clienti sito coordinamento coordinatore "
    "cooperativa cooperazione zoologico microonde"
).split()
IT_PRONOUNS = "come cosa cos'è cos'e perché perche quando dove quale quali chi quanto quanti quante".split()
IT_MARKERS = {
    "transactional": "prezzo prezzi costo comprare compra acquistare acquisto offerta offerte sconto sconti vendita spedizione economico".split(),
    "commercial": "migliori migliore recensione recensioni confronto paragone vs alternativa alternative opinioni top".split(),
    "informational": [*IT_PRONOUNS, *"guida significato tutorial esempi esempio differenza differenze".split()],
    "navigational": "login,accedi,accesso,sito,area clienti,registrati".split(","),
}

# The six signals of the citation checklist, what each needs and asks for, and its grounds; the action texts are part of the output.
CHECKLIST = {
    "extractability": ("offline", "Open each section with a self-contained answer of 25 words or fewer, before the detail."),
    "entity_coverage": ("offline", "Name and define the cluster's key entities; close the owned-gap entities first."),
    "structured_signals": ("offline", "Add a table or ordered list and at least one explicit statistic with its unit."),
    "information_gain": ("passage_text", "Add information beyond the competing pages; answer the gatekeeper sub-queries and the missing fan-out angles."),
    "freshness_proxy": ("offline", "Show a visible publication or update date; refresh on a cadence that matches the demand trend."),
    "source_cues": ("passage_text", "Cite authoritative sources, add an author byline with credentials, and Organization schema with sameAs links."),
}
CHECKLIST_BASIS = {
    "questions": "answer-shaped queries in the cluster",
    "no_questions": "no answer-shaped query detected; add question-form subheadings",
    "entities": "topical authority and entity gaps",
    "features": "SERP features present for this cluster",
    "no_features": "no structured SERP feature detected; structure still aids passage extraction",
    "fan_out": "gatekeeper sub-queries and missing archetypes",
    "state": "demand state: ",
    "no_state": "demand trend unknown; a visible date still helps",
    "sources": "citation and authorship cues are read from the page, not from the keyword set",
}
