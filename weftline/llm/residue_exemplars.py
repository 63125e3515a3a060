"""Labelled exemplars of residue: (kind, language, text), a row each. They are stock messages of web servers, proxies,
content systems and page builders, and the placeholder forms of common template languages; none is taken from test data.
A caller may pass a table of its own with the same columns."""

from __future__ import annotations

_TEXTS = {
    ("error", "en"): """
404 not found. the requested url was not found on this server.
the page you are looking for could not be found. it may have been moved, renamed or deleted. please check the address and try again, or return to the home page.
oops! that page can't be found. it looks like nothing was found at this location. sorry, we couldn't find what you were looking for; we looked, but this page is missing, gone or no longer exists.
500 internal server error. the server encountered an unexpected error and was unable to complete your request.
an error occurred while processing your request. our team has been notified. if the problem persists, contact support and quote the error code.
something went wrong. an unexpected error has occurred. please reload the page or try again later.
503 service unavailable. the server is temporarily busy or overloaded. please try again in a few minutes.
502 bad gateway. the proxy server received an invalid response from an upstream server. the upstream host gave no answer.
504 gateway timeout. the gateway timed out; no answer came from the upstream server within the time limit of seconds.
400 bad request. your browser sent a request that this server could not understand: malformed syntax, header or parameter; the request could not be read.
403 forbidden. access denied. you do not have permission to access or view this resource on this server. reference number, request id.
429 too many requests. you have been rate limited: too many calls came from your ip address, more than allowed. please wait before sending another request.
error establishing a database connection. could not connect to the database.
database error: query failed with errno, table does not exist.
fatal error: uncaught exception in line. stack trace: at main, at handler, thrown in file.
this content is not available in your country or region. due to licence and copyright reasons we cannot show this video or item in your location.
this account has been suspended. the site owner should contact the hosting provider for more information or get in touch with support, ticket number.
this link has expired or is no longer valid. the shared file or document was removed or taken down days ago. please ask whoever sent it for another link.
please log in or sign in to continue. your session has expired after minutes of inactivity. log in again to view this page or document.
please verify that you are a human. complete the captcha security check below to continue or go on. check the box: i am not a robot.
just a moment. please stand by, we are checking your browser before you can access or enter this website.
loading, please wait.
we are down for scheduled maintenance. our site is under maintenance and will be back soon. check back shortly.
""",
    ("error", "de"): """
404 seite nicht gefunden. die angeforderte seite existiert nicht mehr oder wurde verschoben. bitte prüfen sie die adresse oder gehen sie zur startseite zurück.
die gesuchte seite gibt es leider nicht.
500 interner serverfehler. es ist ein fehler aufgetreten. ihre anfrage konnte nicht verarbeitet werden. bitte versuchen sie es später erneut. fehlercode.
403 zugriff verweigert. sie haben keine berechtigung für diese seite oder diesen bereich. vorgang, vorgangsnummer.
503 dienst nicht verfügbar. wegen wartungsarbeiten ist unser angebot derzeit nicht erreichbar. wir sind in wenigen minuten wieder da.
zu viele anfragen. bitte warten sie einen augenblick.
""",
    ("error", "fr"): """
404 page introuvable. la page demandée ou que vous cherchez n'existe pas, n'existe plus ou a été déplacée. vérifiez l'adresse ou revenez à l'accueil.
500 erreur interne du serveur. une erreur est survenue. votre demande n'a pas pu être traitée.
503 le service est temporairement indisponible pour maintenance. veuillez réessayer dans quelques minutes.
403 accès refusé. vous n'avez pas le droit ou l'autorisation d'accéder à cette page ou de consulter cette ressource. dossier, référence.
trop de requêtes. veuillez patienter.
""",
    ("error", "es"): """
404 página no encontrada. la página o dirección que busca no existe o ha cambiado de lugar. compruebe la dirección o vuelva al inicio.
500 error interno del servidor. se ha producido un error. no se pudo procesar la solicitud. vuelva a intentarlo o a probar más tarde, en unos minutos.
503 servicio no disponible por mantenimiento. inténtelo de nuevo dentro de unos minutos.
403 acceso denegado. usted no tiene permiso para acceder a esta página ni para ver este recurso. referencia.
demasiadas solicitudes. espere un momento.
""",
    ("error", "it"): """
404 pagina non trovata. la pagina richiesta o cercata non esiste o è stata spostata. controlla l'indirizzo o torna alla pagina iniziale.
500 errore interno del server. si è verificato un errore. impossibile elaborare la richiesta.
503 il servizio non è al momento disponibile per manutenzione. si prega di riprovare tra qualche minuto o tra pochi minuti.
403 accesso negato. non si dispone o non ha il permesso di accedere a questa pagina o di vedere questa risorsa.
troppe richieste. attendere prego.
""",
    ("error", "pt"): """
404 página não encontrada. a página que procura não existe ou mudou de lugar, ou foi movida. verifique o endereço ou volte ao início.
500 erro interno do servidor. ocorreu um erro. não foi possível processar o pedido.
503 o serviço está temporariamente indisponível para manutenção. tente de novo ou novamente dentro de alguns minutos.
403 acesso negado. não tem permissão ou autorização para aceder a esta página ou ver este recurso.
demasiados pedidos. aguarde um momento.
""",
    ("error", "nl"): """
404 pagina niet gevonden. de gevraagde pagina die u zoekt bestaat niet meer of is verplaatst. controleer het adres of ga terug naar de startpagina.
500 interne serverfout. er is een fout opgetreden. uw verzoek kon niet worden verwerkt.
503 de dienst is tijdelijk niet beschikbaar wegens onderhoud. probeer het over enkele minuten of later opnieuw.
403 toegang geweigerd. u hebt geen toestemming om deze pagina of dit te bekijken.
te veel verzoeken. even geduld.
""",
    ("error", "ru"): """
404 страница не найдена. запрошенная страница не существует, удалена или была перемещена. проверьте адрес или вернитесь на главную.
500 внутренняя ошибка сервера. произошла ошибка. не удалось обработать запрос.
503 сервис временно недоступен из-за технических работ. пожалуйста, повторите попытку позже, через несколько минут.
403 доступ запрещён. у вас нет прав или разрешения на просмотр этой страницы или этого ресурса.
слишком много запросов. подождите.
""",
    ("script", "en"): """
you need to enable javascript to run this app. please enable or activate javascript to view this page or site.
we're sorry but this site doesn't work properly without javascript enabled. please enable it to continue.
for full functionality of this site it is necessary to enable javascript. here are the instructions how to enable scripting in your web browser settings.
your browser is not supported or too old: it does not support the features required by this site. please upgrade or update to a modern browser.
javascript is disabled or turned off in your browser. turn it on in the settings, allow it and reload the page. this application requires scripts to run.
if nothing happens or the page does not load, your browser or an extension may be blocking scripts. this content needs client-side code to be drawn in your browser; allow it to continue.
please enable javascript and cookies to continue. this page needs them before it can load.
noscript: javascript off. switch js on and reload.
""",
    ("script", "de"): """
bitte aktivieren sie javascript in ihrem browser, um diese seite zu sehen oder zu nutzen. javascript ist ausgeschaltet.
diese anwendung oder website funktioniert nur mit javascript; sie läuft nicht ohne aktives oder eingeschaltetes scripting. ohne skripten lässt sie sich nicht anzeigen.
ihr browser wird nicht unterstützt oder blockiert skripte. der inhalt der seite kann nicht angezeigt oder geladen werden.
""",
    ("script", "fr"): """
veuillez activer javascript dans votre navigateur pour afficher ou voir cette page. javascript est désactivé.
cette application ou ce site ne fonctionne pas sans javascript, qu'avec les scripts activés.
votre navigateur n'est pas pris en charge ou bloque les scripts. le contenu de la page ne peut pas s'afficher ni être chargé.
""",
    ("script", "es"): """
active o habilite javascript en su navegador para ver esta página. javascript está desactivado.
esta aplicación o este sitio no funciona sin javascript; necesita que los scripts estén permitidos o habilitados.
su navegador no es compatible o bloquea los scripts. el contenido de la página no puede mostrarse ni cargarse.
""",
    ("script", "it"): """
attiva, attivare o abilitare javascript nel browser per vedere o visualizzare questa pagina. javascript è disattivato.
questa applicazione o questo sito funziona solo con javascript, con gli script attivi o abilitati.
il tuo browser non è supportato o blocca gli script. il contenuto della pagina non può essere mostrato o caricato.
""",
    ("script", "pt"): """
ative ou habilite o javascript no seu navegador para ver esta página. o javascript está desativado.
esta aplicação ou este site não funciona sem javascript; precisa de scripts para funcionar.
o seu navegador não é compatível ou bloqueia os scripts. o conteúdo da página não pode ser mostrado ou carregado.
""",
    ("script", "nl"): """
schakel javascript in uw browser in om deze pagina te bekijken. javascript is uitgeschakeld.
deze toepassing of website werkt alleen met javascript, niet zonder scripts.
uw browser wordt niet ondersteund of blokkeert scripts. de inhoud van de pagina kan niet worden getoond of geladen.
""",
    ("script", "ru"): """
включите javascript в браузере, чтобы увидеть или просмотреть эту страницу. javascript отключён.
это приложение или сайт не работает без javascript; для работы приложения нужны скрипты.
ваш браузер не поддерживается или блокирует скрипты. содержимое страницы не может быть показано или загружено.
""",
    ("filler", "en"): """
this is a sample page or example paragraph. replace this placeholder text with your own words or content before publishing.
i'm a paragraph. click here to add your own text and edit me.
this is dummy text or dummy copy, for layout and demonstration purposes only. sample content. text to be supplied by the client.
your headline goes here. your text goes here. section title, heading 1, headline.
insert or add your description here. write something here; tell visitors about yourself or describe your company.
coming soon: more about us and our company. this page or area is under construction; introduction and teaser text will follow.
hello world, test test test. blah blah blah.
""",
    ("filler", "de"): """
hier steht ihr text. hier kommt später ihr text hin.
dies ist ein blindtext, beispieltext oder platzhalter für die beschreibung, ein text ohne inhalt.
bitte ersetzen sie diesen absatz durch ihren eigenen text. ihre überschrift, beispielüberschrift.
""",
    ("filler", "fr"): """
votre texte ici. ajoutez ici votre description; description à compléter.
ceci est un texte d'exemple ou un paragraphe d'exemple à remplacer, texte factice pour la mise en page. titre provisoire.
""",
    ("filler", "es"): """
aquí va su texto. escriba aquí su descripción; descripción pendiente.
este es un párrafo o texto de ejemplo o de muestra que debe sustituirse, texto de relleno para la maqueta. título provisional.
""",
    ("filler", "it"): """
qui va il tuo testo, il suo testo. inserire qui la descrizione; descrizione da completare.
questo è un paragrafo o testo di esempio da sostituire, testo segnaposto per l'impaginazione. titolo provvisorio.
""",
    ("filler", "pt"): """
o seu texto aqui. escreva aqui a sua descrição; descrição a completar.
este é um parágrafo ou texto de exemplo a substituir, texto de preenchimento para a maqueta. título provisório.
""",
    ("filler", "nl"): """
hier komt uw tekst. voeg hier uw beschrijving toe.
dit is een voorbeeldtekst of voorbeeldalinea die vervangen moet worden, opvultekst voor de opmaak. voorlopige titel.
""",
    ("filler", "ru"): """
здесь будет ваш текст. добавьте сюда описание.
это пример текста или абзаца, который нужно заменить; текст-заполнитель для макета. временный заголовок.
""",
    ("placeholder", ""): """
{{ name }}
{{name}}
{{ user.name }}
{{ name | filter }}
{% block name %}
<%= name %>
${name}
${user.name}
#{name}
{name}
{user.name}
{NAME}
%NAME%
%name%
@@NAME@@
__NAME__
[NAME]
[PRODUCT NAME]
[insert name here]
[add text]
[enter title]
[your name here]
[type something]
[replace this]
[choose one]
[put text here]
""",
}
#: Rows of (kind, language, text).
EXEMPLARS: list[tuple[str, str, str]] = [(kind, lang, line) for (kind, lang), lines in _TEXTS.items() for line in lines.strip().split("\n")]
