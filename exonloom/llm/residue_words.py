"""Classes of message templates: what a sentence says is read from the concepts of its words, in many languages, not from phrases.

Every word is looked up in a lexicon of stems by concept. A sentence is residue only if all of its constant words are known - at
positions that the tree found to vary any word may stand - and its concepts form one of the classes; a sentence that opens like a
change description (an imperative of the trade, a scope, a ticket) is none. So real messages about error pages, placeholders or
scripts, which have words of their own, don't pass."""

from __future__ import annotations

import re
from functools import lru_cache

SLOT, REPEAT, NUMBER, NAME, WILD = "⟨slot⟩", "⟨repeat⟩", "#", "⟨name⟩", "<*>"

#: Classes of residue, the one that tells most first. 'frame' and 'beside' are no residue by themselves.
CLASSES = ("scripts_required", "error_page", "filler", "placeholder")

# ---- fixed values: stems by concept; a final '-' stands for any ending ---------------------------------------------------------
# English first, then German, French, Spanish, Portuguese, Italian, Dutch, Swedish, Danish and Norwegian, Finnish, Polish, Czech,
# Russian and Ukrainian, Turkish, Japanese, Chinese, Korean.

STEMS = {
    "script": "java javascript javascripts js script scripts scripting ecmascript javascriptu javascriptet javascriptia javascriptin javascriptiä skript- noscript скрипт- сценари- джаваскрипт- яваскрипт- スクリプト 脚本 스크립트 자바스크립트",
    "enable": "sure make ensure aktivér aktivera obsługę obsługi 活性化해 활성화해 有効にし 有効化 enable enabled enabling activate activated allow allowed permit permitted unblock turn turned switch switched active aktivier- einschalt- eingeschalt- schalt- erlaub- zulass- zulässt activer activez activé active autoris- habilit- activar activa activo activado permit- ativ- abilit- attiv- inschakel- schakel- ingeschakeld zet aktivera- aktiver- slå slår påslag- ota ottaa käyttöön salli włącz- zezwól zapn- povol- включ- разреш- увімкн- дозволь- etkinleştir- etkin açın açık aç 有効 启用 啟用 開啟 开启 打开 活性化 활성화 켜",
    "disabled": "disabled blocked deactivated inactive block blocks blocking disables off deaktiviert blockiert ausgeschaltet abgeschaltet blockier- désactiv- bloqu- deshabilit- desactiv- bloque- desativ- desabilit- disabilit- disattiv- uitgeschakeld geblokkeerd inaktiver- avstäng- blocker- deaktiver- slukket avslått estetty poistettu pois wyłącz- zablok- vypnut- zakázán- отключ- выключ- заблок- вимкнен- devre dışı kapalı engel- 無効 オフ 禁用 停用 关闭 已禁用 비활성",
    "need": "krev- need needs needed require required requires requirement necessary must should mandatory rely relies depend depends support supports supported without benötig- erforder- brauch- muss müssen notwendig unterstütz- ohne nécess- requi- exige doit devez besoin sans prend necesi- requier- necesari- debe deben precis- requer necessár- obrigat- obligat- deve devem richie- necessari- bisogna occorre vereis- nodig moet zonder kräv- behöv- måste utan kræv- nødvendig skal uden uten vaad- vaati- edellyt- tarvit- wymag- potrzeb- konieczn- musi bez vyžad- potřeb- требу- необходим- нуж- должен потрібн- потребу- gerek- lazım zorunlu olmadan 必要 必须 需要 필요 필수",
    "browser": "browser browsers browsersettings webbrowser navigateur navegador navegadores webbläsare- webbläsaren nettleser- selain- selaim- przeglądar- prohlížeč- браузер- переглядач- tarayıcı- ブラウザー ブラウザ 浏览器 瀏覽器 브라우저 cookies cookie kookie-",
    "thing": "aplicação aplicación aplicativo applicazione applicatie aplikacj- aplikac- приложени- застосунок sovellus uygulama- applikasjon- anfrage- žádost- żądani- solicitud- solicitação demande- richiesta verzoek запрос- istek istek- begäran forespørs- webové witryn- アプリ 应用 應用 앱 데이터베이스 数据库 page pages site website webpage content contents commit commits file files diff diffs history viewer change changes branch branches repository repo document link resource url view log patch issue tree blob project text app application web web-app list revision revisions release tag panel index panel service server servers host system connection gateway proxy origin backend database request requests address feature website's path route object item window tab seite seiten inhalt- änderung- datei- dienst adresse anwendung webseite- modification- contenu- fichier- dépôt serveur ressource adresse página paginas páginas contenido- cambio- archivo- servidor sitio recurso conteúdo- alteraç- ficheiro- arquivo- recurso sito contenut- modific- risorsa servizio pagina pagina's inhoud wijziging- bestand- website dienst sida sidan sidor innehåll- ändring- fil filen tjänst- siden side sider indhold- innhold- ændring- endring- tjenest- sivu- sisält- sisäl- palvel- tiedosto- muutok- stron- treść treści zmian- plik- serwis- serwer- zasób zasobu usług- stránk- obsah- soubor- služb- страниц- содержим- контент- сайт- изменени- файл- сервер- сервис- ресурс- сторінк- вміст- sayfa- içeri- dosya- sunucu- site siteyi değişiklik- ページ サイト コンテンツ コミット ファイル 変更 サーバー サーバ サービス リクエスト 页面 頁面 网页 網頁 网站 站点 内容 提交 文件 更改 服务器 伺服器 服务 請求 请求 此页 頁 页 페이지 사이트 콘텐츠 파일 서버 서비스 변경",
    "view": "verder gaan zobrazen- procura- cerca- cherch- sucht- such- processing wyświetleni- tittade pokazan- view viewing see show shown display displayed displaying load loaded loading render rendered open opened opening continue proceed use used using read access reach reached find fetch fetched retrieve retrieved get process processed work works working run running complete completed handle handled look looking looked looks wanted asked ask asking requested requesting tried try trying visit serve served stays stay remains remain stayed appear appears seem seems correctly properly blank empty white hidden anzeig- angezeigt anzuzeig- anzusehen einzusehen seh- lad- geladen weiter- fortfahr- fortzufahren nutzen öffn- abgerufen verarbeit- funktionier- angeforder- gesucht- bleibt leer voir affich- charg- continu- utilis- ouvrir consult- traité- trait- demand- ver mostrar cargar- continuar usar abrir acced- procesar procesad- solicit- visualiz- exibir carregar processar processad- vedere mostra- caricar- continuare usare aprire elabora- richiest- bekijk- weer- laden doorgaan gebruik- openen verwerk- opgevraag- geladen visa visas se ladda- fortsätt- använd- läsa öppna behandla- begär- vise vises fortsæt- fortsett- bruge bruke åbne åpne indlæs- behandl- näyt- näe katso- jatka- ladata käyt- avata käsit- wyświetl- zobacz- kontynuow- załadow- wczyt- otworzyć przetworz- żądan- szukan- działa zobraz- pokračov- načíst načten- zpracov- požadov- просм- увид- отобраз- показ- продолж- загруз- открыть обработ- запрошен- запраш- работ- переглян- продовж- завантаж- görüntüle- görmek devam yükle- açmak kullan- işlen- istenen aradığınız çalış- 表示 閲覧 続行 続ける 読み込み 読み込む 利用 使用 見る 処理 お探し 要求 查看 显示 顯示 浏览 瀏覽 继续 繼續 加载 載入 处理 訪問 访问 使用 보려 보기 표시 계속 로드 이용 사용 처리 요청",
    "error": "misgegaan schiefgelaufen error errors wrong problem problems trouble failure exception crash crashed fehler problem erreur erro errore erros error- problema problème fout fel felet fejl feil virhe- błąd błęd- chyb- problém ошибк- помилк- проблем- hata hatası sorun エラー 错误 錯誤 出错 故障 问题 오류 에러 문제 oops whoops uh-oh oh hoppla ups oeps hoppsan oho",
    "happened": "experiencing misgegaan occurred occur happened encountered went gone passiert aufgetreten ereignet schief gelaufen schiefgelaufen gegangen survenu- produit- passé- mal ocurri- ocurrido producid- producido salió salido salio mal ocorreu aconteceu deu errado verificat- storto andato opgetreden gegaan misgegaan mis inträffa- uppstod uppstått gick snett fel opstod opstået skete sket gik galt skjedde oppst- gikk tapahtu- meni pieleen wystąpi- poszło nie tak nastal- došlo stalo произош- возник- случил- пошло не так сталася виникла oluştu meydana geldi ters gitti 発生 起きました 问题 发生 發生 了 발생 broke pokazilo pokazil",
    "failed": "impossibile imposible behörighet- adgang brak dostępu accès establishing lost bestaat verwijderd verwijderde eliminad- supprim- gelöscht- usunięt- smazán- odstraněn- удален- удалён- видален- silin- kaldırıl- poistettu slettet fjernet borttag- rimoss- cancellat- eliminat- insufficient unhandled uprawnień uprawnienia uprawnienie 删除 刪除 移除 прав slow downtime unavailable interrupted broken dead lost mangler mancano rate allowed took long found denied forbidden unauthorized unauthorised refused rejected unavailable overloaded offline down busy maintenance unreachable unresponsive responding respond responded reset timeout time-out timed gone moved deleted removed exceeded reached exhausted expired ended invalid missing failed unable unavailable exist exists limit quota cannot can't couldn't couldn’t can’t could can able isn't isn’t doesn't doesn’t does did didn't won't wasn't available permitted authorised authorized closed permission permissions privileges rights gateway method implemented conflict payment many bad gefunden verweigert verfügbar erreichbar überlastet gesperrt abgelaufen existiert gelöscht vorhanden fehlgeschlagen wartung konnte konnten möglich berechtigung- zugelassen introuvable- trouvé- refus- interdit- indisponible- inaccessible- surcharg- expir- maintenance existe échou- impossible pu autorisation encontr- denegad- prohibid- disponible- caducad- expirad- manteni- mantenimiento pudo puede pudieron fuera permis- negad- proibid- indispon- disponív- disponi- expirou terminou manuten- pôde possível foi trovat- negat- vietat- scadut- manutenzione possibile potut- inesistente gevonden geweigerd verboden beschikbaar bereikbaar overbelast verlopen onderhoud kon mislukt toegestaan hittades hittas nekad- nekas åtkomst tillgänglig- otillgänglig- överbelast- utgått löpt underhåll kunde misslyckades fundet findes nægtet afvist tilgængelig- utilgængelig- overbelast- udløbet vedligehold- kunne mislykkedes funnet finnes nektet tilgjengelig- utilgjengelig- utløpt vedlikehold löydy löytynyt evätty kielletty saatavilla ylikuormit- vanhentunut huolto- voitu epäonnistui znalezion- znaleźć odmow- zabronion- niedostępn- dostępn- przeciążon- wygasł- konserwac- można udało istnieje nalezen- odepřen- zakázan- nedostupn- dostupn- přetížen- vypršel- údržb- nelze podařilo neexistuje найден- запрещ- отказ- недоступ- доступ- перегруж- истек- обслуживан- удалось удается невозможно существует знайден- заборонен- відмовлен- недоступн- вдалося закінчил- bulunamadı bulunamıyor reddedildi engellendi kullanılamıyor kullanılamaz ulaşılamıyor erişilemiyor erişim aşıldı yoğun meşgul bakım süresi doldu edilemedi edilemiyor yüklenemedi yok 見つかりません 見つかりませんでした 拒否 禁止 できません できませんでした 利用できません アクセス メンテナンス 期限切れ 切れ 失敗 存在しません 混雑 找不到 未找到 不存在 拒绝 拒絕 禁止 无法 無法 不可用 超时 逾時 过期 過期 维护 維護 失败 失敗 繁忙 权限 被 찾을 없습니다 거부 금지 만료 점검 실패 접근 접속 수 권한 located",
    "again": "её обновите igjen più reprøv riprova lade laden 試し お試し 試行 重新试 一度 loading again later once more retry reload refresh refreshed back return afterwards shortly moment moments minute minutes second seconds while wait hold checking contact administrator admin administrators webmaster owner maintainer support team help manual documentation settings home start main front previous login log sign signed signing logged account session sessions password credentials id request ray trace incident reference ref correlation event code status try come please kindly sorry thank thanks patience inconvenience apologise apologize apologies know nginx apache cloudflare iis varnish haproxy openresty generated bitte erneut später nochmal noch einmal versuchen probieren neu zurück anmeld- einlogg- melden moment administrator kontaktier- wenden sitzung entschuldig- minuten einstellung- startseite veuillez réessay- recharg- actualis- retour accueil connect- reconnect- patient- plus tard session administrateur contact- désolé- nouveau paramètres quelques por favor intent- vuelva nuevo tarde recarg- actualic- inicie inici- volver sesión administrador contact- disculp- minutos tente novamente mais recarreg- atualiz- volte voltar sessão desculp- riprov- nuovo tardi ricaric- aggiorn- accedi torna sessione amministratore spiacenti minuti probeer opnieuw later herlaad- ververs- terug inloggen log sessie beheerder försök igen senare uppdater- ladda om tillbaka logga session- administratör- kontakta tyvärr ögonblick vänta prøv senere genindlæs- opdater- oppdater- tilbage tilbake log logg session- kontakt administrator- desværre beklager øjeblik øyeblikk vent yritä uudelleen myöhemmin päivitä takaisin kirjaud- istunto ota yhteyttä ylläpi- odota hetki pahoittelemme spróbuj ponownie później odśwież- wróć zaloguj- logow- sesja skontaktuj- administrator- przepraszamy chwil- czekaj proszę zkuste znovu později obnov- zpět přihlas- relace kontaktujte prosím omlouváme počkejte попробу- повтор- позже снова ещё еще обнов- вернит- войд- войти авториз- сеанс сессия свяжитесь администратор- извините подождите пожалуйста спробуйте пізніше знову оновіть увійдіть lütfen tekrar daha sonra deneyin yenileyin geri dön giriş oturum- yönetici- iletişim üzgünüz bekleyin お手数 もう一度 再度 後で しばらく お待ち 再読み込み 再試行 ログイン 戻る セッション 管理者 お問い合わせ 申し訳 ください 下さい してから 稍后 稍後 再试 再試 重试 重試 刷新 重新 登录 登入 返回 会话 會話 管理员 管理員 联系 聯繫 抱歉 对不起 请 請 다시 나중에 잠시 시도 새로고침 로그인 세션 관리자 문의 죄송 하세요 하십시오 주세요 notified inténtelo попытку",
    "text": "opis 文字 描述 text texts copy title message description content explanation summary body subject details copy notes comment wording sentence section paragraph line lines words word block topic heading texte titre contenu texto título titulo descripción descrição mensaje mensagem contenido conteúdo titel beschreibung inhalt nachricht testo titolo tekst titel beskrivning rubrik beskrivelse teksti otsikko kuvaus tytuł opis treść popis текст описание заголовок текст опис metin başlık açıklama テキスト 本文 タイトル 説明 文章 文本 标题 描述 内容 文字 텍스트 제목 설명 내용 descrizion-",
    "here": "insert enter 填写 填寫 輸入 输入 wpisz wprowadź wstaw введите вставьте infoga skriv inserisci escriba ingrese insérer saisir einfügen eingeben invoer voeg added here goes go comes follow follows following coming belongs soon later intentionally deliberately left blank reserved kept space place pending final hier steht stehen folgt kommt später hin ici viendra suivra venir sera ajouté ajoutée aquí aqui va vai irá vendrá virá viene vem añadirá mais tarde más tarde qui verrà hier komt later här kommer senare her kommer senere tähän tulee tutaj będzie później zde bude později здесь будет позже тут буде buraya gelecek sonra ここ 入ります 入力 这里 此处 這裡 在此 여기 inserire compléter",
    "filler": "placeholder placeholders filler dummy sample example mock lorem ipsum blah bla tbd tba xxx foo asdf blindtext platzhalter- beispieltext mustertext fülltext remplissage factice exemple provisoire relleno ejemplo exemplo preenchimento prueba teste segnaposto esempio riempitivo voorbeeldtekst opvul- platshållar- exempel- utfyllnad pladsholder eksempel- plassholder täyte- paikkamerkki zastępcz- przykładow- wypełniacz- zástupn- ukázkov- заполнитель пример- рыба заглушк- приклад- örnek yer tutucu ダミー サンプル プレースホルダー 占位 占位符 示例 样例 더미 예시 샘플",
    "plain": "real actual proper à al dal della dello degli delle nei chez är 일 시 적 인 right now zurzeit pro této tato tohoto nebyla nebyl nebylo nebyly byl byla bylo został została zostało zostały haya haber avez avons hat haben hatte fu furono siano sii vous-même esse essa este isso nenhum ninguna ningún aucun aucune kein keinen keiner nessun nessuna geen żaden žádný никакой mevcut değildir olan olarak oldu edildi edilmiş gibi başka nu nå dann mer meer very please 没 就 也 与 及 或者 那 里 来自 进行 时 對 对 於 于 可以 可 需 让 讓 她 他 best better nieoczekiwan- obsługę blev bliver blivit masz tę те у вас нет вам вы мы она он они inne jest ci cię 或 内部 面 お 試 解 해 해서 또는 inattendu- interni inre intern internt vnitřní iç ett blir är under varmasti aluksi alla så sorry unfortunately valitettavasti bohužel niestety к сожалению helaas helaas malheureusement desafortunadamente lamentablemente infelizmente purtroppo yhden 还 请求 時 few a an the this that these those your you our my we us i it its it's itself is are was were be been being has have had having having do don't not no nor and or but if so because as of to in on for from by with at into within during due up out over under about after before below above here there then than when while which who whom what where why how all any some each every other another both very too also only just currently temporarily still already yet unexpected unknown internal fatal general some something things anything nothing more most less full fully new first next own order reason time times may might will would shall like longer http https error status www safe security check verify verifying ensure human robot und oder der die das den dem des ein eine einen einem einer ist sind war wird werden wurde wurden sein nicht kein keine leider derzeit momentan vorübergehend interner unerwarteter ihr ihre ihrem ihren ihrer dein deine deinem sie du es wir um zu zum zur im in am an auf für von vom mit bei aus dass mehr zugriff zugang diese dieser dieses diesen alle etwas da le la les l un une des du de d et ou est sont a ont été être il elle on nous vous votre vos notre ce cet cette ces ne n pas plus pour par sur dans avec en au aux que qui quelque chose s c y actuellement temporairement interne inattendue inconnue accès el los las lo una uno unos y o es son está están fue ha han se su sus tu nuestro este esta estos no en del al con por para que hay algo un actualmente temporalmente interno inesperado acceso o os as um uma e é são estão foi há seu sua neste nesta na no nas nos do da dos das ao em com não que algo atualmente temporariamente acesso il i gli uno è sono ha stato stata si di a da nel nella per con non questo questa tuo tua suo qualcosa che al accesso momento de het een en is zijn was werd wordt heeft er je uw jouw deze dit die van naar op in met voor om te niet geen iets momenteel toegang och eller en ett den det de är var har din ditt denna detta inte för att i på av med till vid något sin tillfälligt åtkomst og en et er var har din dit denne dette ikke for at i på af av med til noget noe der adgang tilgang on ei ja tämä tämän sinun että voi olla pääsy jokin i w na do z ze się nie jest są był została ten ta to tej twój twoja twojej aby żeby dostęp coś chwilowo obecnie a v na se je jsou byl byla tato tento tuto váš vaše vašem aby přístup něco и в на с со не был была было ваш ваша вашем вашего этот эта эту этой этого для чтобы по к что-то что доступ временно сейчас та у це цей цю щоб вашому bir bu şu ve veya için ile de da değil şey sizin lütfen şu anda geçici olarak の を に は が で と も て た い し ま す です ます した する して から まで この その が ない ため には では 的 了 在 是 您 你 我 们 我们 此 该 这 本 个 以 和 并 将 已 未 后 中 上 来 以便 才 能 到 出 先 所 有 不 一 个 에 을 를 이 가 은 는 의 로 으로 에서 합니다 있습니다 됩니다 되었습니다 했습니다 하려면 이 jotain",
    "number": "one two three four five ten",
}
#: Status lines of replies, word by word; with a number, or alone, they are an error page.
STATUS = "bad request unauthorized payment required forbidden not found method allowed request timeout time-out conflict gone too many requests internal server error not implemented bad gateway service unavailable gateway timeout moved permanently access denied proxy origin temporarily"
#: Imperatives that open a change description.
TRADE = set("check reset trace copy load explain add adds added fix fixes fixed show shows let lets replace replaces drop drops document reject rejects escape escapes translate detect stop stops expand handle remove removes update updates make makes print raise catch ignore log skip skips test tests send map hide rename move refactor improve introduce avoid prevent ensure support merge revert bump implement extract convert simplify clean clarify mention describe rewrite reword style format align adjust tweak pin seed cache guard validate warn throw report rework split join sort parse strip trim limit disable retry redirect return returns render renders mark treat respect tell teach give keep clear swap serve send install configure "
    "refresh reload wait обработать исправить добавить удалить обновить исправлен исправлена добавлен добавлена corrige corriger ajoute ajouter supprime añade añadir arregla corregir corrigir adiciona adicionar remove aggiunge aggiungi correggi "
    "neue neuer neues nueva nuevo nouvelle nouveau новая новый новое nowa nowy nowe ny nytt nieuwe nieuw "
    "behebt behebe füge ergänze entferne korrigiert voeg herstel verwijder lägg fixa tilføj fjern legg dodaj popraw usuń napraw přidat opravit odstranit ekle düzelt kaldır".split())
#: The same where words aren't parted.
TRADE_EAST = re.compile(r"追加|修正|修复|修復|添加|增加|更新し|優化|优化|重构|추가|수정")
#: Words that only frame slots in a commit template.
SCAFFOLD = set(
    "closes close fixes fix resolves refs ref ticket issue enter why how what where who impact context change changes summary description details subject body title scope type "
    "reviewer author version reason please fill in out the template release since feat chore docs refactor perf test build ci style merge request pull see for to and of by a todo tbd fixme "
    "grund kurzbeschreibung beschreibung warum was wie raison pourquoi quoi comment motivo razon por que qué como cómo porque your commit message text longer short explanation here is this checklist steps testing related notes".split()
)
#: Filler Latin, and the endings by which other Latin is known.
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo "
    "consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "at vero eos accusam justo duo dolores rebum stet clita kasd gubergren sea takimata sanctus nam liber tempor cum soluta nobis eleifend option congue nihil imperdiet doming quod mazim placerat facer".split()
)
#: More words that only occur in filler Latin.
LATIN |= set("curabitur pretium tincidunt lacus nulla gravida orci odio nullam varius turpis pharetra pellentesque habitant morbi tristique senectus netus malesuada fames egestas vestibulum vivamus praesent maecenas mauris ultrices sapien suspendisse aenean donec phasellus quisque fusce etiam integer rhoncus ornare lobortis viverra hendrerit accumsan perspiciatis nunc dignissim sodales sem tellus molestie blandit massa nec dui unde omnis iste natus voluptatem accusantium doloremque".split())
_LATIN_END = re.compile(r"(?:us|um|is|ae|am|em|it|ur|nt|que|or|os|as|es|ibus|orum|arum|ere|are|ire|at|et|ut|a|o|i|e|im|at|ex|ac|nec|vel|in|ad)$")
_ENGLISH = set("the and of is are to for with this that was from when which not but it on by as".split())

_WORDS: dict[str, set[str]] = {}
_STARTS: dict[str, set[str]] = {}
for _c, _list in STEMS.items():
    for _w in _list.split():
        (_STARTS if _w.endswith("-") else _WORDS).setdefault(_w.rstrip("-"), set()).add(_c)
for _w in STATUS.split():
    _WORDS.setdefault(_w, set()).add("status")
_EAST = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_LONGEST = max(len(w) for w in _WORDS if _EAST.search(w))


@lru_cache(1 << 16)
def concepts(word: str) -> frozenset[str]:
    """Concepts of a lower-case word; none for an unknown one."""
    found = set(_WORDS.get(word, ()))
    for k in range(3, len(word) + 1):
        found |= _STARTS.get(word[:k], set())
    parts = re.split(r"['’-]", word)
    if not found and len(parts) > 1:  # endings after an apostrophe, compounds
        each = [concepts(p) for p in (parts[:1] if re.search("['’]", word) else parts)]
        found = set().union(*each) if all(each) else found
    return frozenset(found)


def words_of(sentence: str) -> list[str]:
    """Words, marks of slots, names and wildcards; runs of scripts without blanks are cut into the longest known pieces."""
    out = []
    for w in re.findall(r"⟨\w+⟩|<\*>|#|[^\W\d_]+(?:['’-][^\W\d_]+)*", sentence):
        if not _EAST.search(w):
            out.append(w)
            continue
        i = 0
        while i < len(w):
            k = next((k for k in range(min(_LONGEST, len(w) - i), 0, -1) if w[i : i + k] in _WORDS or w[i : i + k] in _STARTS), 1)
            out.append(w[i : i + k])
            i += k
    return out


def is_open(word: str) -> bool:
    """Words without a concept, which may vary within a template."""
    core = word.strip("\"'`´‘’“”.,;:!?()[]{}<>*=-–—…|/")
    return not any(concepts(w) for w in words_of(core)) and core not in (SLOT.strip("⟨⟩"), "") and core not in SCAFFOLD


def is_latin(words: list[str]) -> bool:
    """Filler Latin: mostly its best-known words, or several of them among words that end like Latin."""
    if len(words) < 5 or sum(w in _ENGLISH for w in words) > len(words) / 10:
        return False
    known = sum(w in LATIN for w in words) / len(words)
    return known >= 0.9 or known >= 0.15 and sum(bool(_LATIN_END.search(w)) for w in words) >= 0.75 * len(words)


def sentence_class(template: str) -> str | None:
    """Class of one sentence template: placeholder, filler, error_page, scripts_required; 'frame' for the words around slots, 'beside' for
    what may stand beside an error page or a notice; None for ordinary text."""
    if template == REPEAT:
        return "filler"
    every = words_of(template)
    real = [w for w in every if w not in (SLOT, NUMBER, NAME, WILD)]
    if SLOT in every and all(w in SCAFFOLD for w in real) and WILD not in every:
        return "placeholder"
    if is_latin(real) or len(real) >= 3 and all(w in LATIN for w in real):
        return "filler"
    if real and all(w in LATIN for w in real) and not {"lorem", "ipsum"} <= set(real):
        return "frame"  # the end of a paragraph
    if real and all(w in SCAFFOLD for w in real) and not any(w in (NUMBER, NAME, WILD) for w in every) and len(real) <= 6:
        frame = "frame"
    else:
        frame = None
    if SLOT in every or not every or re.match(r"\[?[\w-]+-(?:#|\d+)\]|\w+(?:\([^)]*\))?!?: \S", template) and not re.match(r"(?:error|http|code|status|fehler|erreur|erro|errore|request|req|ray|trace|id|note|notice|sorry|warning|nginx)\b", template):
        return frame
    if {"lorem", "ipsum"} <= set(real) and all(w in LATIN for w in real):
        return "filler"
    if real[:1] and real[0] in ("add", "insert", "put", "enter", "write", "type") and real[-1] == "here" and all(w in SCAFFOLD or concepts(w) & {"text", "here", "plain"} for w in real[1:]):
        return "filler"
    if frame and {"short", "longer", "brief", "detailed"} & set(real) and {"description", "summary", "explanation", "text"} & set(real):
        return "placeholder"
    if not real:
        return "error_page" if every == [NUMBER] and re.match(r"#$", template) is None else frame or ("beside" if NAME in every or NUMBER in every else None)
    meant = [concepts(w) for w in real]
    has = set().union(*meant)
    # one word in six may be unknown where two kinds of concepts speak for themselves
    english = bool({"the", "a", "an", "is", "are", "to", "of", "for", "in", "on", "and", "with", "from", "by", "at", "off", "that", "this", "these", "your", "it", "not", "be", "has", "have", "when", "before", "after"} & set(real))
    strange = sum(not m and not re.fullmatch("[\u3040-\u309f]", w) for m, w in zip(meant, real))  # syllables of endings are none
    known = strange <= len(meant) // (6 if english else 3) and (not strange or len(has & {"script", "need", "enable", "disabled", "browser", "failed", "error", "happened", "view", "again", "thing"}) >= (3 if english else 2))
    known &= not strange or "script" in has or {"error", "happened"} <= has or bool({"you", "your", "we", "please"} & set(real)) or not "".join(real).isascii()
    meant = [m for m in meant if m]
    wild = sum(w == WILD for w in every)
    trade = TRADE_EAST.search(template) or real[0] in TRADE and not (real[0] == "log" and real[1:2] and real[1] in ("in", "out", "on", "opnieuw"))
    if not known or every[0] == WILD or wild > max(1, len(every) / 5) or trade and not (real[0] in ("retry", "refresh", "reload", "wait") and (len(real) == 1 or real[1] in ("the", "this", "your", "page", "and", "or", "to", "later", "shortly", "again", "once", "a", "for", "please"))):
        return frame
    sayings = lambda *c: sum(bool(m & set(c)) for m in meant)
    if "script" in has and (has & {"enable", "disabled", "need"}) or "script" in has and "browser" in has:
        return "scripts_required"
    only = lambda c: all(c in m for m in meant)
    if only("status") and (len(real) > 1 or NUMBER in every or real[0] in ("forbidden", "gone", "unauthorized")):
        return "error_page"
    if "filler" in has and all(m & {"filler", "text", "here", "plain", "number", "need"} for m in meant):
        return "filler"
    if "text" in has and "here" in has and all(m & {"text", "here", "plain", "again", "view"} for m in meant) and (len(real) <= 12):
        return "filler"
    if "here" in has and sayings("here") >= 2 and all(m & {"text", "here", "plain", "view"} for m in meant) and {"reserved", "blank", "pending", "follow", "follows"} & set(real):
        return "filler"
    if "failed" in has and (sayings("thing", "view", "again", "error", "status") or sum(m != {"plain"} for m in meant) <= 4) and (sayings("failed") >= 2 or len(real) <= 8 or sayings("thing", "again")):
        if all(m <= {"failed", "plain"} for m in meant) and len(real) < 2:
            return frame
        return "error_page"
    if sayings("happened") >= 2 and len(real) <= 6 and all(m & {"happened", "plain", "error", "view", "again"} for m in meant):
        return "error_page"
    if "error" in has and ("happened" in has or len(real) <= 4 and "view" not in has or "again" in has and "view" not in has):
        return "error_page"
    if NUMBER in every and set(real) <= {"http", "error", "status", "code", "fehler", "erreur", "erro", "errore", "fout", "fel", "https"}:
        return "error_page"
    if "view" in has and re.search(r"\b(?:log|sign) ?in\b", template):
        return "error_page"
    if has & {"again"} or NUMBER in every and has <= {"again", "plain"}:
        return "beside"
    return frame
