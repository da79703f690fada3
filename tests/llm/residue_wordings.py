"""Wordings of residue in many languages, and ordinary messages about such things, written apart from the lexicon."""

RESIDUE = r"""
You must have JavaScript enabled to see the commit.
Whoops, looks like something went wrong.
nginx: 504 Gateway Time-out
Your request could not be processed.
Curabitur pretium tincidunt lacus. Nulla gravida orci a odio. Nullam varius, turpis et commodo pharetra.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.
Aby wyświetlić tę stronę, włącz obsługę JavaScript w przeglądarce.
Strona nie została znaleziona.
Wystąpił nieoczekiwany błąd. Spróbuj ponownie później.
Для просмотра этой страницы включите JavaScript в браузере.
Страница не найдена
Произошла ошибка. Попробуйте позже.
Доступ запрещён.
このページを表示するには JavaScript を有効にしてください。
ページが見つかりませんでした。
エラーが発生しました。しばらくしてからもう一度お試しください。
Du måste aktivera JavaScript för att visa sidan.
Sidan kunde inte hittas.
Ett fel har uppstått. Försök igen senare.
Aktivér JavaScript for at se denne side.
Siden blev ikke fundet.
Der opstod en fejl. Prøv igen senere.
请启用 JavaScript 以查看此页面。
页面不存在或已被删除。
服务器内部错误，请稍后再试。
Bu sayfayı görüntülemek için JavaScript'i etkinleştirin.
Sayfa bulunamadı.
Bir hata oluştu. Lütfen daha sonra tekrar deneyin.
We're sorry, but this application doesn't work properly without JavaScript enabled.
This app works best with JavaScript enabled.
403 Forbidden nginx/1.18.0
The requested URL was not found on this server.
Too many requests, please slow down.
An unhandled exception occurred while processing your request.
La página solicitada no existe.
Une erreur s'est produite, veuillez réessayer plus tard.
Er is iets misgegaan. Probeer het later opnieuw.
Javascript moet ingeschakeld zijn om deze pagina te bekijken.
Abilita JavaScript nel tuo browser per continuare.
La pagina richiesta non è stata trovata.
Nie masz uprawnień do wyświetlenia tej strony.
У вас нет прав для просмотра этой страницы.
JavaScript 를 활성화해 주세요.
Insert description here
Description goes here...
<Why is this change needed?>
<!-- Describe your change here -->
[Describe: what and why]
Beschreibung folgt später.
Tutaj będzie opis.
Здесь будет текст.
ここにテキストが入ります。
此处填写描述
TBD
Looks like JavaScript is not available in your browser.
To use this site, please make sure that scripts are allowed.
We noticed that JavaScript is turned off.
It seems that your browser does not run JavaScript.
The page isn't working right now. Try again in a few minutes.
Error establishing a database connection
500 Internal Server Error\n\nThe server encountered an internal error and was unable to complete your request.
This content is not available.
We couldn't find the page you were looking for.
You don't have permission to access this resource.
Your connection was interrupted. Please reload the page.
This link has expired.
Service temporarily unavailable. Please check back later.
Request timed out. Please retry.
502 Bad Gateway\n\nopenresty
Access to this resource has been denied.
Il sito non è al momento disponibile. Riprova più tardi.
Per visualizzare questa pagina è necessario JavaScript.
Deze website vereist JavaScript.
De pagina bestaat niet of is verwijderd.
Tämä sivu vaatii JavaScriptin.
Sivua ei löytynyt.
Pro zobrazení této stránky je vyžadován JavaScript.
Stránka nebyla nalezena.
Denne siden krever JavaScript.
Noe gikk galt. Prøv igjen senere.
이 페이지를 보려면 자바스크립트가 필요합니다.
페이지를 찾을 수 없습니다.
Esta aplicação requer JavaScript.
A página que procura não foi encontrada.
El servidor no está disponible en este momento.
Debe habilitar JavaScript para continuar.
Le serveur est temporairement indisponible.
Pour continuer, activez JavaScript dans votre navigateur.
Der Server ist zurzeit nicht erreichbar.
Ihre Anfrage konnte nicht verarbeitet werden.
Serwis chwilowo niedostępny.
Ta strona wymaga obsługi JavaScript.
Сервис временно недоступен.
Эта страница требует JavaScript.
Sunucu hatası. Lütfen tekrar deneyin.
Tarayıcınızda JavaScript devre dışı.
アクセスが拒否されました。
JavaScript が無効になっています。
您没有权限访问此页面。
您的浏览器已禁用 JavaScript。
Jouw sessie is verlopen. Log opnieuw in.
Tu sesión ha expirado.
Här kommer text senare.
Platzhalter für die Beschreibung
Vivamus sagittis lacus vel augue laoreet rutrum faucibus dolor auctor. Maecenas faucibus mollis interdum.
Praesent libero. Sed cursus ante dapibus diam. Sed nisi. Nulla quis sem at nibh elementum imperdiet.
Add your description here
Short description of the change
{short_summary}\n\n{long_description}
%SUMMARY%
Sample text. Sample text.
Lorem ipsum
Scripts are disabled, so this view cannot be displayed.
Your browser must support JavaScript to open the repository.
This repository viewer requires JavaScript. Please turn it on and reload.
Sorry! That page doesn't exist.
Oops! An unexpected problem happened.
The resource you requested has been moved or deleted.
We are experiencing problems with our servers. Please try again later.
Gateway timeout. The server did not respond in time.
Your account does not have access to this project.
Please log in to view this commit.
Die Seite konnte nicht geladen werden.
Für diese Seite wird JavaScript benötigt.
Vous n'avez pas accès à cette page.
Le chargement de la page a échoué. Réessayez.
No se pudo cargar la página. Vuelva a intentarlo más tarde.
Su navegador no tiene JavaScript activado.
Não foi possível carregar a página.
O JavaScript está desativado no seu navegador.
Impossibile caricare la pagina.
Schakel JavaScript in om verder te gaan.
Du har inte behörighet att visa den här sidan.
JavaScript är avstängt i din webbläsare.
Du har ikke adgang til denne side.
Brak dostępu do strony.
Twoja przeglądarka nie obsługuje JavaScript.
Не удалось загрузить страницу. Обновите её.
Ваш браузер не поддерживает JavaScript.
Erişim reddedildi.
Sayfa yüklenemedi.
ご利用のブラウザでは JavaScript がオフになっています。
セッションの有効期限が切れました。再度ログインしてください。
访问被拒绝。
加载失败，请刷新页面。
일시적인 오류가 발생했습니다. 나중에 다시 시도하세요.
Insert commit message here
<describe the problem this solves>
[Optional: longer explanation]
TODO: write a description
Hier kommt später eine Beschreibung hin.
Le texte viendra plus tard.
Nunc sed velit dignissim sodales ut eu sem integer. Tellus molestie nunc non blandit massa enim nec dui.
JavaScript seems to be off in your browser settings.
You are using a browser with scripting turned off.
Please allow scripts to run so that the commit can be displayed.
This viewer cannot run without JavaScript.
Enable JS and reload this page to continue.
The requested page could not be located.
Something broke on our side. Please come back later.
The server is overloaded right now. Please try again shortly.
Your session timed out. Please sign in again.
You are not authorized to view this repository.
Error 521: web server is down
HTTP ERROR 500
Sorry, we could not load this commit.
Bad Gateway
The connection to the server was reset.
Rate limit exceeded. Try again in 60 seconds.
Unexpected error. Our team has been notified.
We are down for maintenance. We will be back soon.
Internal error: please contact the administrator.
404 - Page not found
Type your message here.
Enter a short description of your changes
Your text here
Commit message goes here
Description to be added
<title>\n\n<body>
{{ subject }}\n\n{{ body }}
[TICKET-ID] <short summary>
${COMMIT_TITLE}
TODO: describe the change
Dummy text, to be replaced
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Donec id elit non mi porta gravida at eget metus. Cras mattis consectetur purus sit amet fermentum.
Morbi leo risus, porta ac consectetur ac, vestibulum at eros. Aenean lacinia bibendum nulla sed.
Bitte aktivieren Sie JavaScript, um fortzufahren.
Ihr Browser unterstützt kein JavaScript.
Es ist ein unerwarteter Fehler aufgetreten.
Die angeforderte Seite existiert nicht mehr.
Zugriff verweigert.
Hier den Text einfügen
Veuillez activer JavaScript pour afficher ce contenu.
La page demandée est introuvable.
Accès refusé. Vous devez vous connecter.
Texte à compléter
Active JavaScript para ver este contenido.
Se ha producido un error interno. Inténtelo de nuevo.
Acceso denegado
Escriba aquí la descripción
Ative o JavaScript para continuar.
Ocorreu um erro inesperado. Tente novamente.
Si è verificato un errore. Riprova.
Inserire qui la descrizione
Er is een fout opgetreden. Probeer het opnieuw.
Toegang geweigerd.
Något gick fel. Försök igen.
Åtkomst nekad.
Adgang nægtet.
Włącz JavaScript, aby kontynuować.
Coś poszło nie tak. Spróbuj ponownie.
Что-то пошло не так. Повторите попытку позже.
Включите JavaScript для продолжения.
Внутренняя ошибка сервера.
Увімкніть JavaScript, щоб продовжити.
Сторінку не знайдено.
JavaScript gerekli. Lütfen etkinleştirin.
Beklenmeyen bir hata oluştu.
JavaScript を有効にしてページを再読み込みしてください。
サーバーエラーが発生しました。
ただいまメンテナンス中です。
您需要启用 JavaScript 才能继续。
系统繁忙，请稍后重试。
找不到页面。
요청하신 페이지를 찾을 수 없습니다.
서버 오류가 발생했습니다.
Jotain meni pieleen. Yritä uudelleen.
Něco se pokazilo. Zkuste to znovu.
"""

ORDINARY = r"""
Handle missing JavaScript runtime in the installer
Show a friendlier 404 page
Remove lorem ipsum from landing page
Fix error page when session expired
Return 503 while the cache warms up
Log the request id of failed requests
Enable JavaScript linting in CI
Add Polish translation of the not found page
Seite nicht gefunden: Übersetzung ergänzt
Disable scripts in the preview frame
Update copy on the access denied screen
Increase rate limit for the search endpoint
Make retry interval configurable
Server: drop support for TLS 1.0
Improve error message for missing files
Use placeholder text color from theme
Corrige la page d'erreur 404
Исправлена ошибка загрузки страницы
サーバーエラーの処理を修正
修复页面加载错误
Require JavaScript 1.8 for the build scripts
Page cache: evict expired sessions
Support loading scripts from the gateway
Service worker: show offline page
Move description below title
Rename status page to health page
Typo
WIP
release 2.3.1
Test 404 and 500 handlers
Wait for server before running scripts
Do not load scripts twice
Browser support table
Error handling
Document how to enable scripts
Timeout for requests is now 30 seconds
Explain why JavaScript is required on the login page
Viewer: keep the panel visible without JavaScript
Handle 502 from the gateway
Session expiry is now configurable
Clean up unavailable servers
Access denied page gets a new layout
Cookies are no longer required by the session handler
Error codes for failed requests
Block scripts from unknown origins
Turn off JavaScript minification
Page not found handler for nested routes
Swap the text of title and description
Text wrapping in descriptions
Retries: wait longer between requests
Failing request no longer blocks the queue
Reload page after login
Refresh session before it expires
Load scripts asynchronously
Vivid colours for the dashboard
Server status endpoint
Allow access without a session
Use the correct status code when a page is missing
Die Fehlerseite zeigt jetzt den Status
Ajoute une page d'erreur
Añade la página de error 404
Обработать ошибку сервера
エラーページを追加
添加错误页面
The cache used to pad slowly, which left weighted routers behind
Title and description are optional
Without this the page would load twice
Request and response logging
Errors are shown in the panel
Sign in again when the session has expired
Loading of files is faster
Render the viewer without scripts when possible
Show why a page cannot be displayed
Page moved to the new repository
Bring back the disabled scripts panel
Pages load once per session
Browser tests run without cookies
The server no longer responds twice
Denied requests are counted per minute
Guard against missing files
Access to deleted branches is refused
Files that cannot be read are reported
Requests with an expired session get 401
Kein Zugriff mehr auf gelöschte Dateien
Page d'accueil plus rapide
La página de inicio carga más rápido
Страница загружается быстрее
ページの読み込みを高速化
页面加载更快
Describe the placeholder syntax
Commit message template with two slots
Explain [optional] arguments in the help
Lorem generator uses a fixed seed
Show maintenance banner while the server restarts
Fix typo in the access denied message
Fall back to plain HTML when scripts are off
Rename error page template
Catch unexpected errors in the worker
Return 404 for deleted commits
Translate error messages to German
Retry on connection reset
Do not show the stack trace to users
Sessions time out after ten minutes
Placeholder images for missing avatars
Template for release notes
Fill in missing descriptions in the schema
Log why the connection was refused
Raise rate limit to 60 requests
Move scripts to the bottom of the page
JavaScript bundle is 20 kB smaller
Server errors now carry a request id
Pages without a title get a default
Handle sign in errors
Fehlermeldung beim Laden der Seite verbessert
Neue Seite für Wartung
Message d'erreur plus clair
Nuevo mensaje de error para sesiones
Новая страница ошибки
Улучшено сообщение об ошибке
エラーメッセージを改善
优化错误提示
Nieuwe foutpagina
Ny felsida
Nowa strona błędu
Fix crash when JavaScript is disabled
The browser check no longer needs cookies
Notify the team about internal errors
Maintenance mode for the gateway
Lorem ipsum text replaced with real copy
Tests for the not found page
Text fields accept longer descriptions
Back off when the rate limit is exceeded
Insert rows in batches
"""
