"""Texts to measure the residue rules by, written down before the rules were revised and kept apart from the lists of test_residue.

Pages and notices are the standard texts of public servers, browsers, proxies and frameworks, or plain translations of them;
placeholders are those of public template languages and mail tools. The rules are not to be fitted to single entries here.
"""

PAGES = [
    "404 Not Found\nnginx/1.18.0 (Ubuntu)",
    "Not Found\n\nThe requested URL was not found on this server.\n\nApache/2.4.41 (Ubuntu) Server at example.com Port 80",
    "Forbidden\n\nYou don't have permission to access this resource.\n\nApache/2.4.52 Server at example.org Port 443",
    "502 Bad Gateway\nThe server is temporarily unavailable. Please try again later.",
    "503 Service Temporarily Unavailable\nnginx",
    "Internal Server Error\n\nThe server encountered an internal error or misconfiguration and was unable to complete your request.\n\nPlease contact the server administrator and inform them of the time the error occurred.",
    "Sorry, you have been blocked\nYou are unable to access this website.\nThis website is using a security service to protect itself from online attacks.",
    "This site can't be reached\nThe server IP address could not be found.\nERR_NAME_NOT_RESOLVED",
    "Checking if the site connection is secure\nThis site needs to review the security of your connection before proceeding.",
    "Error 1020\nAccess denied\nThis website is using a security service to protect itself from online attacks.",
    "Error 521: Web server is down",
    "Access Denied\nYou don't have permission to access \"http://www.example.com/\" on this server.\nReference #18.2f3e1702.1612345678.1a2b3c4d",
    "Error establishing a database connection",
    "There has been a critical error on this website. Please check your site admin email inbox for instructions.",
    "The page you are looking for does not exist or has been moved.",
    "Oops! That page can't be found.\nIt looks like nothing was found at this location. Maybe try a search?",
    "Whitelabel Error Page\nThis application has no explicit mapping for /error, so you are seeing this as a fallback.\nThere was an unexpected error (type=Not Found, status=404).",
    "HTTP Error 404.0 - Not Found\nThe resource you are looking for has been removed, had its name changed, or is temporarily unavailable.",
    "Server Error in '/' Application.\nRuntime Error",
    "We're sorry, but something went wrong.\nIf you are the application owner check the logs for more information.",
    "The change you wanted was rejected. Maybe you tried to change something you didn't have access to.",
    "Application error\nAn error occurred in the application and your page could not be served. If you are the application owner, check your logs for details.",
    "Guru Meditation:\nXID: 32773\nVarnish cache server",
    "ERROR: The requested URL could not be retrieved\nUnable to determine IP address from host name.",
    "504 Gateway Time-out\nThe server didn't respond in time.",
    "<?xml version=\"1.0\" encoding=\"UTF-8\"?>\n<Error><Code>AccessDenied</Code><Message>Access Denied</Message><RequestId>4442587FB7D0A2F9</RequestId></Error>",
    '{"error": {"code": 401, "message": "Request had invalid authentication credentials."}}',
    '{"message": "Not Found", "documentation_url": "https://docs.example.com/rest", "status": "404"}',
    "Your connection is not private\nAttackers might be trying to steal your information from this site.\nNET::ERR_CERT_DATE_INVALID",
    "This content is no longer available.",
    "Please log in to continue.",
    "You must be logged in to view this page.",
    "Your session has timed out. Please sign in again.",
    "Verify you are human by completing the action below.",
    "Our systems have detected unusual traffic from your computer network.",
    "We'll be back soon! The site is undergoing scheduled maintenance.",
    "Briefly unavailable for scheduled maintenance. Check back in a minute.",
    "429 Too Many Requests\nYou have sent too many requests in a given amount of time.",
    "This account has been suspended.\nContact your hosting provider for more information.",
    "Pagina non trovata\nLa pagina richiesta non esiste o è stata spostata.",
    "Errore 500: errore interno del server. Riprova più tardi.",
    "Страница не найдена. Ошибка 404.",
    "Доступ запрещён",
    "Pagina niet gevonden. De opgevraagde pagina bestaat niet (meer).",
    "Nie znaleziono strony. Błąd 404.",
    "Die angeforderte Seite wurde nicht gefunden. Bitte überprüfen Sie die Adresse.",
    "Zugriff verweigert. Sie haben keine Berechtigung, diese Seite anzuzeigen.",
    "La page demandée est introuvable ou a été supprimée.",
    "La página que busca no existe o ha sido eliminada.",
    "A página que você procura não existe ou foi removida.",
]
NOTICES = [
    "You need to enable JavaScript to run this app.",
    "Please turn JavaScript on and reload the page.",
    "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.",
    "JavaScript is disabled in your browser.\nPlease enable JavaScript to proceed.\nA required part of this site couldn't load. This may be due to a browser extension, network issues, or browser settings.",
    "This site requires JavaScript and cookies to be enabled.",
    "Enable JavaScript and cookies to continue",
    "To use this site, please enable JavaScript in your web browser.",
    "Your browser has JavaScript turned off. Some features of this site will not work.",
    "JavaScript must be enabled in order for you to use this page.",
    "For full functionality of this site it is necessary to enable JavaScript.",
    "Please disable your ad blocker and enable scripts to view this content.",
    "JavaScript is not available.\nWe've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser to continue.",
    "noscript: this page cannot be displayed without JavaScript",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite nutzen zu können.",
    "Für die volle Funktionalität dieser Website ist JavaScript erforderlich.",
    "Veuillez activer JavaScript pour continuer.",
    "Ce site nécessite JavaScript pour fonctionner correctement.",
    "Por favor, habilite JavaScript en su navegador para continuar.",
    "Este sitio requiere que JavaScript esté activado.",
    "Por favor, ative o JavaScript no seu navegador para continuar.",
    "È necessario abilitare JavaScript per utilizzare questo sito.",
    "Per favore attiva JavaScript per continuare.",
    "Пожалуйста, включите JavaScript в вашем браузере.",
    "Schakel JavaScript in om deze pagina te bekijken.",
    "Włącz obsługę JavaScript, aby wyświetlić tę stronę.",
]
SLOTS = [
    "Hi {{firstName}},\n\nthank you for your purchase.",
    "Dear {{ customer.last_name|title }}, your invoice is attached.",
    "Hello {$name}, welcome aboard.",
    "Dear *|FNAME|*, we have news for you.",
    "Hello %%FIRSTNAME%%, your code is ready.",
    "Dear [Customer Name],\n\nthank you for contacting us.",
    "Sincerely,\n[Your Name]\n[Your Position]",
    "Hi [FIRST NAME], we noticed you left something behind.",
    "Your appointment is on <DATE> at <TIME>.",
    "Dear <Insert Name Here>, we regret to inform you.",
    "Hello ${user.firstName}, your order has shipped.",
    "Hello #{user.name}, your trial ends soon.",
    "Your order <%= order.id %> has been received.",
    "Total: {amount} {currency}",
    "Hi {first_name}! Your subscription ends on {end_date}.",
    "Dear @FirstName@, please find the report attached.",
    "Dear {!Contact.FirstName}, thank you for your interest.",
    "Hallo [Ihr Name], vielen Dank für Ihre Anfrage.",
    "Sehr geehrte/r [Name einfügen], anbei die Rechnung.",
    "Bonjour [Prénom], votre commande est prête.",
    "Estimado [Nombre del cliente], su pedido está listo.",
    "Prezado [nome do cliente], segue o relatório.",
    "Gentile {{nome}}, la ringraziamo per il suo ordine.",
    "Name: ____________________\nDate: ____________________",
    "The meeting takes place at [LOCATION] on [DATE].",
    "Company: [COMPANY NAME]\nAddress: [COMPANY ADDRESS]",
    "Contact us at [phone number] or [email address].",
    "[Insert company logo here]",
    "TODO: write the introduction",
    "Price: $XXX.XX per month",
]
FILLER = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.",
    "Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.",
    "test test test test",
    "foo bar baz foo bar baz foo bar baz",
    "asdf asdf asdf asdf",
    "qwertz qwertz qwertz",
    "aaaaaaaa bbbbbbbb cccccccc",
    "yada yada yada yada",
    "bla bla bla bla bla",
    "This is a placeholder text. It will be replaced with real content.",
    "Your text goes here.",
    "Insert your text here.",
    "Content coming soon.",
    "Sample text for the description.",
    "Dies ist ein Platzhaltertext.",
    "Hier steht Ihr Text.",
    "Ceci est un texte d'exemple à remplacer.",
    "Este es un texto de ejemplo.",
    "Este é um texto de exemplo.",
    "Testo segnaposto da sostituire.",
    "Description to be added.",
    "Lorem Ipsum is simply dummy text of the printing and typesetting industry.",
]
CLEAN = [
    "The server returns 404 Not Found when the file is missing, so check the path first.",
    "A 502 Bad Gateway means that nginx cannot reach your application server. Look at its log.",
    "I keep getting 'Access denied' after the update. What can I do?",
    "You can enable JavaScript in the settings of your browser, under Privacy.",
    "Set the status code to 503 and add a Retry-After header during maintenance.",
    "In Jinja you write {{ name }} to print a variable. A filter follows after a bar, as in {{ name|upper }}.",
    "Handlebars replaces every {{placeholder}} in the template with the value of the same name.",
    "The template engine expands ${name} when the string is evaluated; use $${name} to escape it.",
    "In Python, f-strings evaluate {expression} inside the braces at run time.",
    "The expression {x} denotes the singleton set that contains x only.",
    "Use array[INDEX] to read one element of the list.",
    "The generic type List<String> keeps the element type.",
    "Run `echo ${HOME}` to see your home folder.",
    "```\nHello {{ name }}\n```\nThis template greets the user.",
    "Lorem ipsum is a text that typesetters have used since the 1500s; see its history on the web.",
    "How do I generate lorem ipsum of a given length in Python?",
    "My page shows \"Please enable JavaScript\" although it is on. Why?",
    "The error page of our site is static, so it also works when the database is down.",
    "If the session expires, the user has to log in again; store the draft on the client.",
    "It works now, thanks a lot!",
    "Yes.",
    "+1",
    "See the answer above.",
    "No, no, no. That is very, very wrong.",
    "The very very long name is cut off.",
    "He said that that that that he used was superfluous.",
    "Restart the service and try again later if the port is still in use.",
    "The resource was moved to another bucket last week, so update the link in the config.",
    "Your browser caches the script, so clear the cache or change its name.",
    "The gateway times out after 30 seconds because the query has no index.",
    "Not found in the documentation, but it works: pass None.",
    "The page is not found by the crawler because of the robots file.",
    "Permission denied means that the file has the wrong owner. Run chown.",
    "Set [DEFAULT] in the ini file, then a section per host.",
    "Use %s for strings and %d for numbers in the format.",
    "The password is shown as **** in the log.",
    "In Markdown, [text](url) makes a link and ![alt](url) an image.",
    "Write <b> for bold text and <i> for italics.",
    "Die Seite liefert 404, weil der Pfad falsch ist.",
    "Le serveur renvoie 500 quand la base est arrêtée.",
    "El servidor devuelve 403 porque falta el permiso.",
    "O servidor devolve 404 quando o ficheiro não existe.",
    "Wenn JavaScript aus ist, wird das Formular trotzdem gesendet.",
    "Sans JavaScript, le menu reste ouvert, c'est voulu.",
    "The text is a sample of 1,000 records; a sample text is not needed.",
    "You have to replace this line by your own path in line 3.",
    "Mary had a little lamb, little lamb, little lamb.",
    "x = x + 1 adds one.",
    "The set of all sets that are not members of themselves is a paradox.",
    "Die Antwort folgt aus der Definition.",
]
