"""Vocabularies and weights of the search semantics."""

# Results depend on each of them.
QUERY_STOP = "the of and de du des la le les der die das und et y for in van von di del da do a an".split()

LEGAL_FORMS = """
    ab aktiebolag aktiebolaget publ as asa aps oy oyj osakeyhtio ehf hf
    gmbh mbh ggmbh ag kg kgaa ohg gbr ug haftungsbeschrankt eg ev co se
    aktiengesellschaft kommanditgesellschaft gesellschaft mit beschrankter haftung
    ltd limited plc llc llp lp inc incorporated corp corporation company public pte pty pvt private
    sa sas sasu sarl eurl sca scs snc sci scop societe anonyme spa srl srls sapa
    sl slu slp sau ltda limitada lda sociedad sociedade anonima por acoes unipessoal unipersonal eireli
    bv nv vof cv cvba bvba naamloze besloten vennootschap sro ks vos akciova spolecnost
    sp z oo spolka akcyjna ograniczona odpowiedzialnoscia komandytowa jawna
    kft zrt nyrt rt tarsasag felelossegu korlatolt reszvenytarsasag mukodo nyilvanosan
    doo dd ad ood eood ou uab sia bhd sdn kk
""".split()

MATCH = {"all": 2.59, "miss": 4.83, "fuzzy": 1.19, "exact": 2.96, "core_exact": 0.55, "prefix": 0.84, "coverage": 2.26, "initials": 6.5, "base_exact": 1.0}

PROMINENCE = {
    "dead": -2.9, "lapsed": -0.39, "fund": 0.32, "gov": 0.0, "children": 0.5, "top": 1.36, "has_parent": -0.56,
    "branches": -0.91, "isin": 0.49, "isin_cap": 3.932, "bic": 0.74, "age": 2.46, "len": -1.01,
}

STATUS_LETTERS = {"ISSUED": "I", "LAPSED": "L", "PENDING_TRANSFER": "T", "PENDING_ARCHIVAL": "P", "RETIRED": "R", "DUPLICATE": "D", "ANNULLED": "A", "MERGED": "M"}
DEAD_REGISTRATION = ("RETIRED", "DUPLICATE", "ANNULLED", "MERGED")
GOVERNMENT = ("RESIDENT_GOVERNMENT_ENTITY", "INTERNATIONAL_ORGANIZATION")

FOLDS = {"æ": "ae", "Æ": "ae", "ø": "o", "Ø": "o", "ß": "ss", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d", "ð": "d", "Ð": "d", "þ": "th", "Þ": "th", "œ": "oe", "Œ": "oe", "ı": "i", "ŋ": "n", "ħ": "h", "ŧ": "t"}

SPLIT, MAX_DEPTH, FILE_POSTINGS, CAP = 1500, 14, 1500, 1500
MIN_CHARS, MAX_SPAN, MAX_ANCHORS = 3, 1, 2
FUZZY_MIN_LENGTH, INITIALS_MIN_PROMINENCE = 4, 1.0
