"""Stemmers, written from the published descriptions (Porter 1980, Paice/Husk 1990, the Snowball definitions).

Each is a pure function of a word; ``stems`` applies one to a column of tokens.
Large corpora stem their vocabulary once with ``stem_vocabulary`` and join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import per_array, per_word

# --- English


def _measure(stem: str) -> int:
    kinds = "".join("v" if c in "aeiou" or c == "y" and i and stem[i - 1] not in "aeiou" else "c" for i, c in enumerate(stem))
    return len(re.findall("v+c+", kinds))


def _has_vowel(stem: str) -> bool:
    return any(c in "aeiou" or c == "y" and i and stem[i - 1] not in "aeiou" for i, c in enumerate(stem))


def _cvc(w: str) -> bool:
    if len(w) < 3 or w[-1] in "aeiouwxy":
        return False
    vowel = lambda i: w[i] in "aeiou" or w[i] == "y" and i > 0 and w[i - 1] not in "aeiou"
    return not vowel(len(w) - 3) and vowel(len(w) - 2) and not vowel(len(w) - 1)


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiou"


_PORTER_2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
_PORTER_3 = dict((x.split(":") + [""])[:2] for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_PORTER_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _suffix(w: str, options) -> str | None:
    return max((s for s in options if w.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    w = word.lower()
    if len(w) < 3:
        return w
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(old):
            w = w[: len(w) - len(old)] + new
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and _has_vowel(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _doubled(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_PORTER_2, _PORTER_3):
        s = _suffix(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _suffix(w, [*_PORTER_4, "ion"])
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


#: The rules of C. Paice and G. Husk (Another Stemmer, 1990) in their own notation and order:
#: reversed ending, * for intact words only, letters to drop, what to append, > to go on or . to stop.
_HUSK = (
    "ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct. hsi3> i*1. i1y> "
    "ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1. "
    "mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. "
    "tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> "
    "ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s."
)
_HUSK_RULES = [(m[1][::-1], m[2] == "*", int(m[3]), m[4], m[5] == ">") for m in re.finditer(r"([a-z]+)(\*?)(\d)([a-z]*)([.>])", _HUSK)]


def lancaster(word: str) -> str:
    w, intact = word.lower(), True
    while True:
        for ending, whole, drop, add, more in _HUSK_RULES:
            if not w.endswith(ending) or whole and not intact:
                continue
            stem = w[: len(w) - drop] + add
            ok = len(stem) >= 2 if stem[:1] in tuple("aeiou") else len(stem) >= 3 and bool(re.search("[aeiouy]", stem))
            if not ok:
                continue
            if drop == 0 and not more:
                return w
            w, intact = stem, False
            if not more:
                return w
            break
        else:
            return w


# --- the Snowball family


def _after_vc(w: str, vowels: str, start: int = 0) -> int:
    """Place behind the first non-vowel that follows a vowel."""
    for i in range(start + 1, len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return i + 1
    return len(w)


def _regions(w: str, vowels: str, least: int = 0) -> tuple[int, int]:
    r1 = _after_vc(w, vowels)
    r2 = _after_vc(w, vowels, r1)
    return max(r1, least) if r1 < len(w) or least else r1, r2


def _in(w: str, options, start: int) -> str | None:
    """Longest option that ends the word and lies behind ``start``."""
    return max((s for s in options if w.endswith(s) and len(w) - len(s) >= start), key=len, default=None)


def german(word: str) -> str:
    v = "aeiouyäöü"
    w = word.lower().replace("ß", "ss")
    w = re.sub(f"(?<=[{v}])([uy])(?=[{v}])", lambda m: m[1].upper(), w)
    r1, r2 = _regions(w, v, 3)
    s = _suffix(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= r1:
        if s == "s":
            w = w[:-1] if w[-2:-1] and w[-2] in "bdfghklmnrt" else w
        else:
            w = w[: -len(s)]
            if s in ("e", "en", "es") and w.endswith("niss"):
                w = w[:-1]
    s = _suffix(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= r1:
        if s != "st" or len(w) > 5 and w[-3] in "bdfghklmnt":
            w = w[: -len(s)]
    s = _suffix(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= r2:
        stem = w[: -len(s)]
        if s in ("end", "ung"):
            w = stem[:-2] if stem.endswith("ig") and not stem.endswith("eig") and len(stem) - 2 >= r2 else stem
        elif s in ("ig", "ik", "isch"):
            w = w if stem.endswith("e") else stem
        elif s in ("lich", "heit"):
            w = stem[:-2] if stem.endswith(("er", "en")) and len(stem) - 2 >= r1 else stem
        else:
            t = _in(stem, ("lich", "ig"), r2)
            w = stem[: -len(t)] if t else stem
    return w.lower().translate(str.maketrans("äöü", "aou"))


def swedish(word: str) -> str:
    w = word.lower()
    v = "aeiouyäåö"
    r1 = max(_after_vc(w, v), 3)
    s = _in(w, "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split(), r1)
    if s:
        w = w[: -len(s)]
    elif w.endswith("s") and len(w) - 1 >= r1 and w[-2:-1] and w[-2] in "bcdfghjklmnoprtvy":
        w = w[:-1]
    if _in(w, ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), r1):
        w = w[:-1]
    s = _in(w, ("lig", "ig", "els", "löst", "fullt"), r1)
    if s:
        w = w[:-1] if s in ("löst", "fullt") else w[: -len(s)]
    return w


def norwegian(word: str) -> str:
    w = word.lower()
    v = "aeiouyæåø"
    r1 = max(_after_vc(w, v), 3)
    s = _in(w, "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast erte ert".split(), r1)
    if s in ("erte", "ert"):
        w = w[: -len(s)] + "er"
    elif s:
        w = w[: -len(s)]
    elif w.endswith("s") and len(w) - 1 >= r1 and len(w) > 1 and (w[-2] in "bcdfghjlmnoprtvyz" or w[-2] == "k" and len(w) > 2 and w[-3] not in v):
        w = w[:-1]
    if _in(w, ("dt", "vt"), r1):
        w = w[:-1]
    s = _in(w, "leg eleg ig eig lig elig els lov elov slov hetslov".split(), r1)
    return w[: -len(s)] if s else w


def _undouble(w: str) -> str:
    return w[:-1] if w.endswith(("kk", "dd", "tt")) else w


def dutch(word: str) -> str:
    """Each word is stemmed by itself; no state is carried from one to the next."""
    v = "aeiouyè"
    w = word.lower().translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(f"^y|(?<=[{v}])y", "Y", w)
    w = re.sub(f"(?<=[{v}])i(?=[{v}])", "I", w)
    r1, r2 = _regions(w, v, 3)

    def en(x: str) -> str:
        return _undouble(x) if x and x[-1] not in v and not x.endswith("gem") else None

    s = _suffix(w, ("heden", "ene", "en", "se", "s"))
    if s and len(w) - len(s) >= r1:
        stem = w[: -len(s)]
        if s == "heden":
            w = stem + "heid"
        elif s in ("ene", "en"):
            w = en(stem) or w
        elif stem and stem[-1] not in v + "j":
            w = stem
    dropped = False
    if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in v:
        w, dropped = _undouble(w[:-1]), True
    if w.endswith("heid") and len(w) - 4 >= r2 and not w.endswith("cheid"):
        w = w[:-4]
        if w.endswith("en") and len(w) - 2 >= r1:
            w = en(w[:-2]) or w
    s = _suffix(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if s and len(w) - len(s) >= r2:
        stem = w[: -len(s)]
        if s in ("end", "ing"):
            w = stem[:-2] if stem.endswith("ig") and not stem.endswith("eig") and len(stem) - 2 >= r2 else _undouble(stem)
        elif s == "ig":
            w = w if stem.endswith("e") else stem
        elif s == "lijk":
            w = stem
            if w.endswith("e") and len(w) - 1 >= r1 and w[-2:-1] and w[-2] not in v:
                w = _undouble(w[:-1])
        elif s == "baar" or dropped:
            w = stem
    if re.search(f"[^{v}I](aa|ee|oo|uu)[^{v}I]$", w):
        w = w[:-2] + w[-1]
    return w.lower()


def _romance_rv(w: str, v: str) -> int:
    if len(w) < 3:
        return len(w)
    if w[1] not in v:
        return next((i + 1 for i in range(2, len(w)) if w[i] in v), len(w))
    if w[0] in v:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in v), len(w))
    return 3


_ES_VERB_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_VERB_GU = "en es éis emos".split()
_ES_VERB = "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split()


def spanish(word: str) -> str:
    v = "aeiouáéíóúü"
    w = word.lower()
    r1, r2 = _regions(w, v)
    rv = _romance_rv(w, v)
    plain = str.maketrans("áéíóú", "aeiou")
    s = _suffix(w, "me se sela selo selas selos la le lo las les los nos".split())
    if s and len(w) - len(s) >= rv:
        stem = w[: -len(s)]
        t = _in(stem, "iéndo ándo ár ér ír".split(), rv)
        if t:
            w = stem.translate(plain)
        elif _in(stem, "iendo ando ar er ir".split(), rv) or stem.endswith("yendo") and stem[-6:-5] == "u" and len(stem) - 5 >= rv:
            w = stem
    before = w
    s = _suffix(w, "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos adora ador ación adoras adores aciones ante antes ancia ancias logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos".split())
    if s:
        stem, at = w[: -len(s)], len(w) - len(s)
        if s in ("logía", "logías"):
            w = stem + "log" if at >= r2 else w
        elif s in ("ución", "uciones"):
            w = stem + "u" if at >= r2 else w
        elif s in ("encia", "encias"):
            w = stem + "ente" if at >= r2 else w
        elif s == "amente":
            if at >= r1:
                w = stem
                t = _in(w, ("iv", "os", "ic", "ad"), r2)
                if t:
                    w = w[:-2]
                    if t == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                        w = w[:-2]
        elif at >= r2:
            w = stem
            if s == "mente":
                t = _in(w, ("ante", "able", "ible"), r2)
            elif s in ("idad", "idades"):
                t = _in(w, ("abil", "ic", "iv"), r2)
            elif s in ("iva", "ivo", "ivas", "ivos"):
                t = _in(w, ("at",), r2)
            elif s in "adora ador ación adoras adores aciones ante antes ancia ancias".split():
                t = _in(w, ("ic",), r2)
            else:
                t = None
            w = w[: -len(t)] if t else w
    if w == before:
        s = _in(w, _ES_VERB_Y, rv)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            s = _in(w, [*_ES_VERB, *_ES_VERB_GU], rv)
            if s:
                w = w[: -len(s)]
                if s in _ES_VERB_GU and w.endswith("gu"):
                    w = w[:-1]
    s = _in(w, "os a o á í ó e é".split(), rv)
    if s:
        w = w[: -len(s)]
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(plain)


_PT_VERB = "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras".split()


def portuguese(word: str) -> str:
    v = "aeiouáéíóúâêô"
    w = word.lower().replace("ã", "a~").replace("õ", "o~")
    r1, r2 = _regions(w, v)
    rv = _romance_rv(w, v)
    before = w
    s = _suffix(w, "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância logia logias ução uções uça~o uço~es ência ências amente mente idade idades iva ivo ivas ivos ira iras".split())
    if s:
        stem, at = w[: -len(s)], len(w) - len(s)
        if s in ("logia", "logias"):
            w = stem + "log" if at >= r2 else w
        elif s.startswith("u"):
            w = stem + "u" if at >= r2 else w
        elif s in ("ência", "ências"):
            w = stem + "ente" if at >= r2 else w
        elif s == "amente":
            if at >= r1:
                w = stem
                t = _in(w, ("iv", "os", "ic", "ad"), r2)
                if t:
                    w = w[:-2]
                    if t == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                        w = w[:-2]
        elif s in ("ira", "iras"):
            w = stem + "ir" if at >= rv and stem.endswith("e") else w
        elif at >= r2:
            w = stem
            t = _in(w, {"mente": ("ante", "avel", "ível"), "idade": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv")}.get(s, ("at",) if s.startswith("iv") else ()), r2)
            w = w[: -len(t)] if t else w
    if w == before:
        s = _in(w, _PT_VERB, rv)
        w = w[: -len(s)] if s else w
    if w != before:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        s = _in(w, "os a i o á í ó".split(), rv)
        w = w[: -len(s)] if s else w
    if w[-1:] in ("e", "é", "ê") and len(w) - 1 >= rv:
        w = w[:-1]
        if (w.endswith("gu") or w.endswith("ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


_IT_CLITIC = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split()
_IT_VERB = "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir".split()


def italian(word: str) -> str:
    v = "aeiouàèìòù"
    w = word.lower().translate(str.maketrans("áéíóú", "àèìòù"))
    w = w.replace("qu", "qU")
    w = re.sub(f"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), w)
    r1, r2 = _regions(w, v)
    rv = _romance_rv(w, v)
    s = _suffix(w, _IT_CLITIC)
    if s and len(w) - len(s) >= rv:
        stem = w[: -len(s)]
        if _in(stem, ("ando", "endo"), rv):
            w = stem
        elif _in(stem, ("ar", "er", "ir"), rv):
            w = stem + "e"
    before = w
    s = _suffix(w, "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti azione azioni atore atori logia logie uzione uzioni usione usioni enza enze amento amenti imento imenti amente ità ivo ivi iva ive".split())
    if s:
        stem, at = w[: -len(s)], len(w) - len(s)
        if s.startswith("log"):
            w = stem + "log" if at >= r2 else w
        elif s[0] == "u":
            w = stem + "u" if at >= r2 else w
        elif s in ("enza", "enze"):
            w = stem + "ente" if at >= r2 else w
        elif s in ("amento", "amenti", "imento", "imenti"):
            w = stem if at >= rv else w
        elif s == "amente":
            if at >= r1:
                w = stem
                t = _in(w, ("iv", "os", "ic", "abil"), r2)
                if t:
                    w = w[: -len(t)]
                    if t == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                        w = w[:-2]
        elif at >= r2:
            w = stem
            if s.startswith("azion") or s.startswith("ator"):
                w = w[:-2] if w.endswith("ic") and len(w) - 2 >= r2 else w
            elif s == "ità":
                t = _in(w, ("abil", "ic", "iv"), r2)
                w = w[: -len(t)] if t else w
            elif s[:2] == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
                w = w[:-2] if w.endswith("ic") and len(w) - 2 >= r2 else w
    if w == before:
        s = _in(w, _IT_VERB, rv)
        w = w[: -len(s)] if s else w
    if w[-1:] and w[-1] in "aeioàèìò" and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("i") and len(w) - 1 >= rv:
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.lower()


_FR_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_FR_VERB = "ions é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def french(word: str) -> str:
    v = "aeiouyâàëéêèïîôûù"
    w = word.lower()
    w = re.sub(f"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), w)
    w = re.sub(f"(?<=[{v}])y|y(?=[{v}])", "Y", w).replace("qu", "qU")
    r1, r2 = _regions(w, v)
    if w.startswith(("par", "col", "tap")) or len(w) > 2 and w[0] in v and w[1] in v:
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in v), len(w))
    before, verbs = w, False
    s = _suffix(w, "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split())
    if s:
        stem, at = w[: -len(s)], len(w) - len(s)
        if s in ("ment", "ments"):
            if len(stem) > rv and stem[-1:] in tuple(v):
                w, verbs = stem, True
        elif s == "amment":
            if at >= rv:
                w, verbs = stem + "ant", True
        elif s == "emment":
            if at >= rv:
                w, verbs = stem + "ent", True
        elif s in ("issement", "issements"):
            w = stem if at >= r1 and stem and stem[-1] not in v else w
        elif s == "eaux":
            w = stem + "eau"
        elif s == "aux":
            w = stem + "al" if at >= r1 else w
        elif s in ("euse", "euses"):
            w = stem if at >= r2 else stem + "eux" if at >= r1 else w
        elif s.startswith("logie"):
            w = stem + "log" if at >= r2 else w
        elif s in ("usion", "ution", "usions", "utions"):
            w = stem + "u" if at >= r2 else w
        elif s in ("ence", "ences"):
            w = stem + "ent" if at >= r2 else w
        elif s in ("ement", "ements"):
            if at >= rv:
                w = stem
                t = _in(w, ("iv", "eus", "abl", "iqU", "ièr", "Ièr"), 0)
                if t == "iv" and len(w) - 2 >= r2:
                    w = w[:-2]
                    w = w[:-2] if w.endswith("at") and len(w) - 2 >= r2 else w
                elif t == "eus":
                    w = w[:-3] if len(w) - 3 >= r2 else w[:-1] + "x" if len(w) - 3 >= r1 else w
                elif t in ("abl", "iqU") and len(w) - 3 >= r2:
                    w = w[:-3]
                elif t in ("ièr", "Ièr") and len(w) - 3 >= rv:
                    w = w[:-3] + "i"
        elif at >= r2:
            w = stem
            if s[:2] in ("at",) and s not in ("ative",):
                if w.endswith("ic"):
                    w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
            elif s in ("ité", "ités"):
                t = _in(w, ("abil", "ic", "iv"), 0)
                if t == "abil":
                    w = w[:-4] if len(w) - 4 >= r2 else w[:-4] + "abl"
                elif t == "ic":
                    w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
                elif t == "iv" and len(w) - 2 >= r2:
                    w = w[:-2]
            elif s in ("if", "ive", "ifs", "ives") and w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("ic"):
                    w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
    changed = w != before and not verbs
    if not changed:
        start = w
        s = _in(w, _FR_I, rv)
        if s and len(w) - len(s) - 1 >= rv and w[-len(s) - 1] not in v:
            w = w[: -len(s)]
        else:
            s = _in(w, _FR_VERB, rv)
            if s and (s != "ions" or len(w) - 4 >= r2):
                w = w[: -len(s)]
                if s in "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split() and w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
        changed = w != start or verbs
        if w == start and not verbs:
            changed = False
    if changed:
        if w.endswith("Y"):
            w = w[:-1] + "i"
        elif w.endswith("ç"):
            w = w[:-1] + "c"
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        s = _suffix(w, ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"))
        if s and len(w) - len(s) >= rv:
            stem = w[: -len(s)]
            if s == "ion":
                w = stem if len(stem) >= r2 and len(stem) - 1 >= rv and stem[-1:] in ("s", "t") else w
            elif s in ("ier", "ière", "Ier", "Ière"):
                w = stem + "i"
            elif s == "e" or stem.endswith("gu"):
                w = stem
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(f"[éè](?=[^{v}]+$)", "e", w)
    return w.lower()


_RU = {
    "gerund1": "в вши вшись".split(), "gerund2": "ив ивши ившись ыв ывши ывшись".split(),
    "adjective": "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split(),
    "part1": "ем нн вш ющ щ".split(), "part2": "ивш ывш ующ".split(), "reflexive": "ся сь".split(),
    "verb1": "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
    "verb2": "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
    "noun": "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split(),
}


def russian(word: str) -> str:
    v = "аеиоуыэюя"
    w = word.lower().replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in v), len(w))
    _, r2 = _regions(w, v)

    def cut(one, two):
        t = _in(w, two, rv) or ""
        s = _in(w, one, rv) or ""
        if len(t) >= len(s) and t:
            return w[: -len(t)]
        if s and len(w) - len(s) - 1 >= rv and w[-len(s) - 1] in "ая":
            return w[: -len(s)]
        return w[: -len(t)] if t else None

    got = cut(_RU["gerund1"], _RU["gerund2"])
    if got is not None:
        w = got
    else:
        s = _in(w, _RU["reflexive"], rv)
        w = w[: -len(s)] if s else w
        s = _in(w, _RU["adjective"], rv)
        if s:
            w = w[: -len(s)]
            got = cut(_RU["part1"], _RU["part2"])
            w = got if got is not None else w
        else:
            got = cut(_RU["verb1"], _RU["verb2"])
            if got is not None:
                w = got
            else:
                s = _in(w, _RU["noun"], rv)
                w = w[: -len(s)] if s else w
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    s = _in(w, ("ость", "ост"), r2)
    w = w[: -len(s)] if s else w
    s = _in(w, ("ейше", "ейш"), rv)
    w = w[: -len(s)] if s else w
    if w.endswith("нн") and len(w) - 1 >= rv or w.endswith("ь") and len(w) - 1 >= rv:
        w = w[:-1]
    return w


_UK = [re.compile(x) for x in ("(ив|ивши|ившись|ыв|ывши|ывшись((?<=[ая])(в|вши|вшись)))$", "(с[яьи])$", "(ими|ій|ий|а|е|ова|ове|ів|є|їй|єє|еє|я|ім|ем|им|их|іх|ою|йми|ої|у|ю|ого|ому)$", "(ий|ого|ому|им|ім|а|ій|у|ою|ів|и|их|йми)$", "(сь|ся|ив|ать|ять|у|ю|ав|али|учи|ячи|вши|ши|е|ме|ати|яти|є)$", "(а|ев|ов|е|ями|ами|еи|и|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я|і|ові|ї|ею|єю|ою|є|еві|єм|ів|їв)$")]


def ukrainian(word: str) -> str:
    w = word.lower().replace("'", "").replace("ʼ", "")
    m = re.match("^(.*?[аеиоуюяіїє])(.*)$", w)
    if not m or not m[2]:
        return w
    head, rv = m[1], m[2]
    new = _UK[0].sub("", rv)
    if new == rv:
        rv = _UK[1].sub("", rv)
        new = _UK[2].sub("", rv)
        if new != rv:
            rv = _UK[3].sub("", new)
        else:
            new = _UK[4].sub("", rv)
            rv = new if new != rv else _UK[5].sub("", rv)
    else:
        rv = new
    rv = re.sub("и$", "", rv)
    if re.search("[^аеиоуюяіїє][аеиоуюяіїє]+[^аеиоуюяіїє]+[аеиоуюяіїє].*(?<=о)сть?$", rv):
        rv = re.sub("ость?$", "", rv)
    rv = re.sub("ь$", "", rv)
    return head + re.sub("нн$", "н", rv)


def japanese(word: str) -> str:
    """One trailing prolonged sound mark goes from katakana of four or more letters."""
    return word[:-1] if len(word) >= 4 and word[-1] == "ー" and all("゠" <= c <= "ヿ" for c in word) else word


def japanese_column(word: Column) -> Column:
    return F.regexp_replace(word, "^([゠-ヿ]{3,})ー$", "$1")


def persian(word: str) -> str:
    return word


def indonesian(word: str, roots: frozenset[str] = frozenset()) -> str:
    """Affixes are taken off until a root of the given dictionary is left; without one, the word stays."""
    w = word.lower()
    if w in roots or "-" in w and w.split("-")[0] == w.split("-")[-1] and w.split("-")[0] in roots:
        return w.split("-")[0]
    tails = [w]
    for options in (("lah", "kah", "tah", "pun"), ("ku", "mu", "nya"), ("kan", "an", "i")):
        tails += [t[: -len(s)] for t in tails for s in options if t.endswith(s) and len(t) > len(s) + 2]
    seen = list(dict.fromkeys(tails))
    for _ in range(3):
        for t in seen:
            if t in roots:
                return t
        new = []
        for t in seen:
            for p in ("di", "ke", "se", "ber", "bel", "be", "ter", "tel", "te", "per", "pel", "pe"):
                if t.startswith(p) and len(t) > len(p) + 2:
                    new.append(t[len(p) :])
            for p, initials in (("meng", ("", "k")), ("meny", ("s",)), ("mem", ("", "p")), ("men", ("", "t")), ("me", ("",)), ("peng", ("", "k")), ("peny", ("s",)), ("pem", ("", "p")), ("pen", ("", "t"))):
                if t.startswith(p):
                    new += [c + t[len(p) :] for c in initials if len(t) > len(p) + 1]
        seen = list(dict.fromkeys(new))
    return w


STEMMERS = {"en": porter, "lancaster": lancaster, "de": german, "es": spanish, "fa": persian, "fr": french, "it": italian, "ja": japanese, "nl": dutch, "no": norwegian, "pt": portuguese, "ru": russian, "sv": swedish, "uk": ukrainian}


def stem(word: Column, language: str = "en") -> Column:
    return per_word(STEMMERS[language], "string")(word)


def stems(tokens: Column, language: str = "en") -> Column:
    return per_array(STEMMERS[language], "string")(tokens)


def stem_vocabulary(tokens: DataFrame, column: str, language: str = "en") -> DataFrame:
    """(word, stem): every distinct token is stemmed once."""
    return tokens.select(F.col(column).alias("word")).distinct().withColumn("stem", stem(F.col("word"), language))


#: Languages whose stop words are compared in lower case, and those whose stemmers read lower case; the others take tokens as they are.
LOWER_STOPS = frozenset({"fr", "no", "pt", "sv"})
LOWER_STEMS = frozenset({"de", "es", "fr", "it", "nl", "ru", "uk"})
#: A token without any of these letters is left as it is.
GATES = {"de": "a-zA-ZäöüßÄÖÜ", "es": "a-zA-ZáéíóúüñÁÉÍÓÚÜÑ", "fr": "a-zA-ZâàçëéêèïîôûùÂÀÇËÉÊÈÏÎÔÛÙ", "it": "a-zA-ZàèéìòùÀÈÉÌÒÙ", "nl": "a-zA-ZäëïöüáéíóúèÄËÏÖÜÁÉÍÓÚÈ", "ru": "а-яёА-ЯЁ", "uk": "а-щьюяіїєґА-ЩЬЮЯІЇЄҐ"}


def tokenize_and_stem(text: Column, language: str = "en", stop_words=None, keep_stops: bool = False) -> Column:
    """Words without stop words unless kept, stemmed; casing and gate are the language's own."""
    from .text import StopWords, word_tokens

    tokens = word_tokens(text)
    if not keep_stops:
        stops = stop_words or StopWords.for_language({"lancaster": "en"}.get(language, language))
        tokens = F.filter(tokens, lambda t: ~stops.holds(F.lower(t) if language in LOWER_STOPS else t))
    gate, fold = re.compile(f"[{GATES[language]}]") if language in GATES else None, language in LOWER_STEMS
    one = STEMMERS[language]

    def stem_one(token: str) -> str:
        given = token.lower() if fold else token
        return given if gate and not gate.search(given) else one(given)

    return per_array(stem_one, "string")(tokens)
