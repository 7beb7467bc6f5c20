"""Problem 7: template residue, filler, error pages and script notices in place of content.

Unfilled placeholders are found by one grammar per delimiter; occurrences inside code, those that are mentioned rather
than left in (``write {{ name }} where``), and those in text that explains such things (its words stand close by) are
discounted, unless placeholders make up most of their line.  Filler, error messages and notices count by density: their
sentences must make up most of the characters of the page's main body.  A message is told by what servers are known to
say, by an incident number, or by a grammar of what failed (page, service, session, ...) and how (not found, expired,
...); every match vouches for so many characters around it (``REACH``), whatever the length of the sentence.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import ahocorasick

from corvina.llm.canonical import transducer

_NAME = r"[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z][A-Za-z0-9_]*)*"
_CAPS = r"[A-Z]{2,}(?:[_ ]+[A-Z]{2,})+"

# One grammar per delimiter.
PLACEHOLDER = re.compile(
    rf"\{{\{{-?\s*{_NAME}(?:\s*\|\s*\w+)*\s*-?\}}\}}"  # {{ name }}
    rf"|\{{%-?\s*\w+(?:\s+{_NAME})*\s*-?%\}}"  # {% block name %}
    rf"|<%[=\-#]?\s*{_NAME}\s*-?%>"  # <%= name %>
    rf"|[$#]\{{\s*{_NAME}\s*\}}"  # ${name} #{name}
    rf"|\[\[\s*{_NAME}\s*\]\]"  # [[name]]
    rf"|%%\s*{_NAME}\s*%%"  # %%name%%
    rf"|(?<![\w_])__{_NAME}__(?![\w_])"  # __name__
    rf"|\[{_CAPS}\]|<{_CAPS}>|\${_CAPS}\$"  # [YOUR NAME] <YOUR NAME> $YOUR NAME$
)

# What any of them must contain, for a quick look.
_MARKS = ("{{", "{%", "<%", "${", "#{", "[[", "%%", "__")
_CAPS_MARK = re.compile(r"[\[<$][A-Z]{2,}[_ ]")

# Words of texts that are about placeholders and templates, in the languages of the corpus.
_ABOUT = re.compile(
    r"placeholder|template|variable|braces?\b|bracket|syntax|snippet|escap|builder|renders?\b|curly|\bcode\b|platzhalter|vorlage|gabarit|accolade|espace réservé|plantilla|marcador|llaves"
    r"|modelo de página|chaves|プレースホルダ|テンプレート|変数|占位符|模板|变量|자리표시자|템플릿|변수",
    re.I,
)

# An occurrence that is mentioned: what stands right before it, and right behind it.
_MENTIONED = re.compile(r"\b(?:writ(?:e|es|ing)|typ(?:e|es|ing)|insert(?:ing)?|put|use(?:s|d)?|using|such as|like|called|named|variable|field|tag|token|e\.g\.|schreiben|schreibe|namens|écrivez|écrire|appelée?|escriba|escribir|llamad[oa]|escreva|escrever|chamad[oa])\s*[`\"“‘'(«]?$", re.I)
_EXPLAINED = re.compile(r"^[`\"”’')»]?\s*(?:where\b|(?:is|are|was|were|gets?|will be) (?:replaced|filled|expanded|rendered|substituted)|stands? for|means?\b|has no value|holds? the|wird (?:durch|ersetzt)|est remplacée?|se sustituye|é substituíd[oa])", re.I)

#: Characters of a sentence that one match of an error message, notice or filler vouches for.
REACH = 260

#: Characters around an occurrence in which words of explanation are looked for.
NEAR = 90

# Words of the customary filler text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat"
    " duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum".split()
)

_FILLER = re.compile(
    r"^(?:(?:text|content|title|heading|headline|description|image|caption)s? goes here|your [\w ]{2,30} here|(?:sample|dummy|placeholder|example) (?:text|content)\b.{0,40}|click to (?:edit|add)\b.{0,40}|coming soon"
    r"|under construction|to ?do\b.{0,60}|tbd|insert [\w ]{2,30} here|heading \d+|(?:add|enter|write) (?:your |a |some )?(?:text|content|title|description)\b.{0,40}|hier steht (?:ihr|der|ein) text|texto de (?:ejemplo|exemplo)"
    r"|texte d'exemple|votre texte ici|su texto aquí|próximamente|em breve|prochainement|demnächst|準備中|近日公開|サンプルテキスト|示例文本|敬请期待|즉시 편집|준비 중(?:입니다)?|샘플 텍스트)[.!… ]*$",
    re.I,
)

# What failed and how, in the languages of the corpus: a sentence that names both says that something failed.
_SUBJECT = r"(?:page|site|website|file|url|address|link|service|server|session|account|host|gateway|database|connection|request|resource|seite|datei|adresse|dienst|server|sitzung|konto|verbindung|anfrage|fichier|adresse|serveur|compte|connexion|requête|ressource|página|sitio|archivo|dirección|servicio|servidor|sesión|cuenta|conexión|solicitud|arquivo|endereço|serviço|sessão|conta|conexão|pedido)"
_STATE = (
    r"(?:not (?:be )?(?:found|available|reached|accessible)|no longer (?:exists|available)|does(?: not|n't) exist|un(?:available|reachable)|timed? ?out|expired|suspended|refused|rejected|failed|overloaded|nicht (?:gefunden|verfügbar|erreichbar|vorhanden|mehr)|abgelaufen|gesperrt|abgelehnt|fehlgeschlagen|überlastet"
    r"|introuvable|indisponible|inaccessible|expirée?|suspendue?|refusée?|rejetée?|échoué|surchargée?|no (?:se )?(?:encontrad[oa]|encuentra|encontró|disponible|está disponible)|caducad[oa]|suspendid[oa]|rechazad[oa]|ha fallado|sobrecargad[oa]|não (?:foi )?(?:encontrad[oa]|está disponível|disponível)|indisponível|expirad[oa]|expirou|suspens[oa]|recusad[oa]|rejeitad[oa]|falhou|sobrecarregad[oa])"
)
_FAILED = re.compile(
    rf"\b{_SUBJECT}\b[^.!?]{{0,40}}\b{_STATE}\b|(?:ページ|サイト|サービス|サーバー|セッション|アカウント|接続)[^。！？]{{0,16}}(?:見つかりません|存在しません|利用できません|できません(?:でした)?。?$|期限切れ|停止|失敗|拒否)"
    r"|(?:页面|网页|网站|服务器?|会话|账户|连接|请求)[^。！？]{0,10}(?:不存在|找不到|不可用|无法访问|已过期|已停用|失败|被拒绝|超时)|(?:페이지|사이트|서비스|서버|세션|계정|연결|요청)[^.!?]{0,16}(?:찾을 수 없|존재하지 않|사용할 수 없|이용할 수 없|만료|정지|실패|거부)",
    re.I,
)

# An incident number: six or more hexadecimal digits with a letter and a figure, on their own.
_INCIDENT = re.compile(r"(?<![0-9a-z_-])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{6,16}(?![0-9a-z_-])", re.I | re.A)

# Numbers and codes are told to a reader in messages: what announces one.
_CODE = re.compile(r"(?:error|request|reference|incident|ray|trace|code|id|fehler|kennung|vorgang|erreur|référence|incidente|referencia|referência|código|erro|编号|代码|错误|番号|コード|エラー|번호|코드|오류)", re.I)

_EMPTY_VALUE = re.compile(r"\b(?:undefined|null|NaN|None|nil)\b|\[object Object\]|N/A")

# What servers and gateways say, in the languages of the corpus.
_ERROR = re.compile(
    r"\b(?:error|fehler|erreur|erro|err)\b.{0,3}\s?[45]\d\d\b|\b[45]\d\d\b.{0,4}(?:error|not found|bad gateway|forbidden|internal server|service unavailable|오류|エラー|错误|お探し|找不到)"
    r"|\bpage not found\b|could not be found on this server|can't find the page|page .{0,80}(?:est introuvable|n'existe pas)|page n'existe (?:pas|plus)|page a été (?:déplacée|supprimée)|seite (?:existiert nicht|wurde (?:verschoben|gelöscht))|página (?:ya no existe|já não existe|ha sido (?:movida|eliminada)|foi (?:movida|removida))|ページは(?:移動|削除)|페이지가 (?:이동|삭제)|页面已(?:被)?(?:移动|删除)|página .{0,80}(?:não foi encontrada|no existe)|no se encontró la página|seite (?:wurde )?nicht gefunden"
    r"|見つかりませんでした|ページが見つかりません|찾을 수 없습니다|找不到(?:您)?(?:访问)?的?页面|页面不存在|\baccess denied\b|\bforbidden\b|permission to (?:view|access)|zugriff verweigert|keine berechtigung|accès (?:refusé|interdit)|acceso denegado|acesso negado"
    r"|접근 권한이 없|アクセスが拒否|アクセス権がありません|无权访问|拒绝访问|没有权限|internal server error|bad gateway|gateway time-?out|service (?:is )?(?:temporarily )?unavailable|upstream (?:sent|timed)|database connection|too many requests"
    r"|account has been suspended|session has expired|contact your hosting|down for maintenance|unavailable due to maintenance|checking your browser|verify(?:ing)? (?:that )?you are (?:a )?human|are you a robot|vorübergehend nicht erreichbar|wartungsarbeiten"
    r"|no disponible por mantenimiento|en maintenance|indisponible|em manutenção|indisponível|점검 중입니다|メンテナンス中|维护中|暂时无法|服务不可用|traceback \(most recent call last\)|^\s*file \".{1,60}\", line \d+|(?:fatal|parse|uncaught|type|key|value|name|attribute|syntax|runtime|index)\s?error\b"
    r"|\b(?:warning|notice|deprecated): .{0,80}(?:undefined|\bon line \d)|exception in thread|stack trace|request id [0-9a-f]{6,}|^ray (?:id )?[0-9a-f]{6,}|kennung [0-9a-f]{6,}|요청 번호 [0-9a-f]{6,}|the page you (?:are looking for|requested)|something went wrong|went wrong on our|\breference [0-9a-f]{6,}|etwas ist schiefgelaufen|une erreur (?:est survenue|s'est produite)|algo (?:salió mal|deu errado)|問題が発生しました|문제가 발생했습니다|出了点问题|go back to the (?:start|home) ?page|it may have been moved or deleted|请求(?:编号|过于频繁)|リクエスト(?:番号|が多すぎ)",
    re.I,
)

# Any match of _ERROR contains one of these; a text without them needs no closer look.
_HINTS = (
    "error|erreur|erro |erro:|erro4|erro5|err |err:|err-|err.|fehler|not found|found on this server|find the page|introuvable|n'existe p|a été déplac|a été supprim|existiert nicht|wurde verschoben|wurde gelöscht|já não existe|ha sido mov|ha sido elim|foi movida|foi removida|移動|削除|페이지가|页面已|encontrada|no existe|encontró|nicht gefunden|見つかり|찾을 수|找不到|不存在|denied|forbidden|permission|verweigert|berechtigung|refusé|interdit|denegado|negado"
    "|접근 권한|アクセス|无权|拒绝|没有权限|internal server|gateway|unavailable|upstream|database connection|too many requests|suspended|expired|your hosting|maintenance|mantenimiento|checking your browser|verify|robot|erreichbar|wartung"
    "|indisponible|manutenção|indisponível|점검|メンテナンス|维护|暂时|服务不可用|traceback|file \"|exception|stack trace|request id|ray |kennung|요청 번호|page you|home page|start page|homepage|startpage|moved or deleted|请求|リクエスト"
    "|went wrong|reference |schiefgelaufen|algo salió|algo deu|問題が発生|문제가 발생|出了点问题"
    "|warning:|notice:|deprecated:|오류|エラー|错误|お探し"
    # the states of the grammar, and what announces an incident number
    "|not be |not available|no longer|not exist|n't exist|unreachable|inaccessible|timed out|timeout|time out|refused|rejected|failed|overload|nicht verf|nicht err|nicht vorh|nicht mehr|abgelaufen|gesperrt|abgelehnt|fehlgeschlagen|überlastet|expir|suspend|rejet|échoué|surcharg|no está|no dispon|encuentra|caducad|rechazad|fallado|sobrecarga|não está|não foi|não dispon|suspens|recusad|rejeitad|falhou|sobrecarreg"
    "|存在し|利用でき|できません|期限切れ|停止|失敗|拒否|不可用|无法|过期|停用|失败|被拒|超时|존재하지|사용할 수 없|이용할 수 없|만료|정지|실패|거부|incident|reference|code|trace|fehlernummer|vorgang|référence|referencia|referência|código|编号|代码|番号|コード|번호|코드"
).split("|")
_HINTED = ahocorasick.Automaton()
for _hint in _HINTS:
    _HINTED.add_word(_hint, True)
_HINTED.make_automaton()

_SCRIPT = re.compile(
    r"(?:enable|turn on|activate|need(?:s)?|requires?|without|allow) (?:to )?(?:enable |activate )?(?:java)?scripts?\b|\bscripts? (?:is |are )?(?:required|disabled|on and reload)|does not (?:run|support) scripts?|some features of this page need javascript|javascript (?:aktivieren|para ver|to (?:view|run)|is (?:required|disabled))"
    r"|aktivieren sie javascript|benötigen javascript|activer javascript|demandent javascript|active javascript|necesitan javascript|ative o javascript|precisam de javascript|javascriptを有効|javascriptが必要|自?바?스?크?립?트를 켜|자바스크립트(?:를 켜|가 필요|를 사용)|启用javascript|需要(?:启用)?javascript",
    re.I,
)

_BAD_TITLE = re.compile(
    r"^(?:(?:error|fehler|erreur|erro)\s*[45]\d\d\b.{0,40}|[45]\d\d\b[ :–-]*(?:not found|bad gateway|forbidden|internal server error|service unavailable|unauthorized|gateway time-?out|error|page not found)?|page not found|not found|access denied|forbidden|service unavailable|bad gateway"
    r"|internal server error|just a moment\W*|attention required.{0,20}|one moment.{0,20}|please wait\W*|are you a robot\W*|security check|checking your browser.{0,20}|seite nicht gefunden|zugriff verweigert|page introuvable|accès refusé|página no encontrada|acceso denegado|página não encontrada|acesso negado"
    r"|ページが見つかりません|アクセスが拒否されました|페이지를 찾을 수 없습니다|접근이 거부되었습니다|页面不存在|页面未找到|访问被拒绝|(?:untitled|new page|untitled document|no title|sin título|sans titre|ohne titel|sem título|無題|제목 없음|无标题)(?: \d+)?|lorem ipsum.*|(?:your )?title (?:goes )?here|title"
    r"|undefined|null|none|nan|\[object object\]|todo|tbd|coming soon|under construction|test page|sample page|heading \d*|add (?:title|text))$",
    re.I,
)


def placeholders(text: str) -> bool:
    """Whether a text in consistent form holds a placeholder left in by mistake."""
    if not any(mark in text for mark in _MARKS) and _CAPS_MARK.search(text) is None:
        return False
    for found in PLACEHOLDER.finditer(text):
        start, end = found.span()
        if text[max(0, start - 1) : start] == "`" or text[end : end + 1] == "`":
            continue
        line, stop = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        if text.startswith(("    ", "\t"), line) or text.count("```", 0, start) % 2:
            continue
        own = text[line : stop if stop >= 0 else len(text)]
        if sum([len(m[0]) for m in PLACEHOLDER.finditer(own)]) * 2 > len(own.strip()):
            return True  # hardly anything else on the line: nothing that explains it
        if _MENTIONED.search(text, max(line, start - NEAR), start) or _EXPLAINED.match(text[end : end + NEAR]):
            continue
        if _ABOUT.search(text, max(0, start - NEAR), start) or _ABOUT.search(text, end, end + NEAR):
            continue
        return True
    return False


def bad_title(title: str | None) -> bool:
    """Whether a title is, or holds, residue, filler, an error message or a notice.  Null and blank titles aren't."""
    if title is None or not title.strip():
        return False
    form = " ".join(transducer().apply(title).split())
    if placeholders(form):
        return True
    # A title may carry the site's name behind a bar; what stands before it decides.
    head = re.split(r"\s[|·–—-]\s", form)[0]
    return _BAD_TITLE.match(head) is not None


def _scripts(text: str) -> bool:
    return "cript" in text or "CRIPT" in text or "스크립트" in text


def is_notice(line: str) -> bool:
    """Whether a line only says that scripts are needed."""
    return _scripts(line) and _SCRIPT.search(line) is not None and len(_SCRIPT.sub("", line).split()) <= 12 and len(line) <= REACH


def is_machine_text(line: str) -> bool:
    """Whether a line is filler, an error message or an empty value."""
    return not (_scripts(line) and _SCRIPT.search(line)) and _residue(line, False)


def replaced(parts: Sequence[str]) -> bool:
    """Whether most of the characters of a main body, given as units, are filler, error messages or notices."""
    total = sum(map(len, parts))
    if not total:
        return False
    words = re.findall(r"[^\W\d_]+", " ".join(parts).lower()) if any("orem" in p or "ipsum" in p for p in parts) else []
    lorem = sum(w in LOREM for w in words)
    filler = lorem >= 4 and lorem >= 0.08 * len(words)
    missed = 0
    for part in sorted(parts, key=len, reverse=True):
        if not _residue(part, filler):
            missed += len(part)
            if missed * 2 >= total:
                return False
    return True


def messages(part: str) -> int:
    """Error messages and script notices in a sentence."""
    found = len(_SCRIPT.findall(part)) if _scripts(part) else 0
    if next(_HINTED.iter(part.lower()), None) is not None:
        found += sum(1 for _ in _ERROR.finditer(part)) or sum(1 for _ in _FAILED.finditer(part)) or (_INCIDENT.search(part) is not None and _CODE.search(part) is not None)
    return found


def _residue(part: str, filler: bool) -> bool:
    if ("undefined" in part or "null" in part or "NaN" in part or "None" in part or "nil" in part or "[object" in part or "N/A" in part) and sum(map(len, _EMPTY_VALUE.findall(part))) * 2 > len(part):
        return True
    if messages(part) * REACH >= len(part) or len(part) <= 180 and _FILLER.match(part):  # nothing longer can match
        return True
    if filler:
        own = re.findall(r"[^\W\d_]+", part.lower())
        return bool(own) and not any(w in _FUNCTION for w in own)
    return False


# Words no filler text has and hardly any sentence lacks.
_FUNCTION = frozenset("the of and is was that with for der die das und ist nicht mit le les des est une pour que el los las del y una por o os as do da um e em não é".split())

