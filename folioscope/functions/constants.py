"""Fixed values that results depend on: character classes, word lists, tables, patterns and weights."""

# Character classes, as ranges of a regular expression.
ARABIC_LETTERS = r"\x{0620}-\x{064A}\x{0671}-\x{06D3}\x{06D5}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFC}"
ARABIC_BLOCK = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
LATIN = "a-zA-Z"
DIGITS = r"0-9\x{0660}-\x{0669}\x{06F0}-\x{06F9}"
DIGITS_ARABIC_INDIC = r"0-9\x{0660}-\x{0669}"
BIDI = r"\x{202A}-\x{202E}\x{2066}-\x{2069}"
TASHKEEL = r"\x{0617}-\x{061A}\x{064B}-\x{0652}"
BLANKS = r" \t\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{001F}"
LINE_ENDS = r"\r\n|[\n\r\x{000B}\x{000C}\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}]"
WORD = r"\p{L}\p{N}_"

# Governorates by the code in national identity numbers.
GOVERNORATES = {
    "01": "القاهرة", "02": "الاسكندرية", "03": "بورسعيد", "04": "السويس", "11": "دمياط", "12": "الدقهلية", "13": "الشرقية", "14": "القليوبية",
    "15": "كفر الشيخ", "16": "الغربية", "17": "المنوفية", "18": "البحيرة", "19": "الاسماعيلية", "21": "الجيزة", "22": "بنى سويف", "23": "الفيوم",
    "24": "المنيا", "25": "اسيوط", "26": "سوهاج", "27": "قنا", "28": "اسوان", "29": "الاقصر", "31": "البحر الاحمر", "32": "الوادى الجديد",
    "33": "مطروح", "34": "شمال سيناء", "35": "جنوب سيناء", "88": "خارج الجمهورية",
}
# Words that mark an address line.
ADDRESS_WORDS = "مركز قسم مدينة قرية كفر ميت عزبة حي حى شارع محافظة برج عمارة شقة مساكن بلوك طريق حارة زقاق التجمع ميدان منطقة اول أول ثان ثاني".split()

# Categories in the order that breaks ties.
CATEGORIES = [
    "id_card", "passport", "driver_license", "invoice", "receipt", "contract", "cv", "bank_document", "form",
    "report", "certificate", "letter", "screenshot", "table", "image_with_text", "generic_document", "unknown",
]
# Keywords of each category, in the order of the signals.
KEYWORDS = {
    "passport": ["جواز سفر", "passport", "republic of egypt passport", "place of birth", "type p", "nationality"],
    "id_card": ["بطاقة تحقيق الشخصية", "جمهورية مصر العربية", "الرقم القومي", "بطاقة رقم قومي", "national id", "identity card"],
    "driver_license": ["رخصة قيادة", "رخصة تسيير", "driving license", "driver license", "driving licence", "فصيلة الدم", "درجة ثانية", "درجة ثالثة", "درجة أولى", "خاصة"],
    "receipt": ["فاتورة مبسطة", "إيصال", "كاشير", "pos", "receipt", "cashier", "change", "tax invoice - simplified", "الباقي", "نقدى", "طريقة الدفع", "order #", "table #", "طلب رقم"],
    "invoice": ["فاتورة", "فاتورة ضريبية", "invoice", "tax invoice", "bill to", "due date", "subtotal", "vat", "ضريبة القيمة المضافة", "إجمالي الفاتورة", "رقم الفاتورة", "تاريخ الاستحقاق"],
    "contract": ["عقد", "اتفاقية", "الطرف الأول", "الطرف الثاني", "الطرف الثانى", "البند", "ديباجة", "مادة", "تم الاتفاق", "agreement", "contract", "parties hereto", "whereas", "terms and conditions"],
    "cv": ["curriculum vitae", "resume", "cv", "experience", "education", "skills", "work experience", "الخبرات", "المؤهلات", "التعليم", "المهارات", "اللغات", "languages", "summary", "projects", "certifications"],
    "bank_document": ["كشف حساب", "رقم الحساب", "iban", "swift", "balance", "debit", "credit", "رصيد", "بنك", "bank", "account statement", "حركات الحساب", "إيداع", "سحب"],
    "form": ["استمارة", "نموذج", "طلب تسجيل", "application form", "form", "signature:", "التوقيع:", "الاسم:", "date:", "التاريخ:"],
    "certificate": ["شهادة", "تشهد", "تقدير", "إتمام", "شهادة تخرج", "certificate", "hereby certified", "awarded to", "completion", "certified that", "شهادة شكر"],
    "letter": ["السيد /", "عناية", "تحية طيبة وبعد", "dear", "to whom it may concern", "sincerely", "regards", "مع وافر الاحترام", "برجاء التكرم", "مرفق لسيادتكم"],
    "report": ["تقرير", "report", "executive summary", "المقدمة", "التوصيات", "الخاتمة", "جدول الأعمال", "annual report", "findings", "conclusion"],
    "screenshot": ["http://", "https://", "www.", ".com", "file", "edit", "view", "settings", "wifi", "battery", "am", "pm", "chrome", "firefox", "status bar", "notification"],
}
SPARSE_EXCEPTIONS = ["جمهورية", "passport", "بطاقة", "invoice", "receipt", "عقد"]
ID_ANCHORS = [
    "الرقم القومي", "الاسم الاول", "الأسم الاول", "باقي الاسم", "محل الاقامة", "محل الإقامة", "تاريخ الميلاد", "تاريخ الاصدار", "تاريخ الإصدار", "رقم المصنع", "تاريخ الانتهاء", "الحالة الاجتماعية",
]
CV_HOSTS, CV_SECTIONS = ["@gmail.com", "@yahoo.com", "linkedin.com", "github.com"], ["experience", "education", "الخبرات"]

# Layout words.
SECTION_WORDS = [
    "البند", "الفصل", "المادة", "ديباجة", "الشروط", "الموضوع", "section", "clause", "article", "summary", "experience", "education", "skills", "projects", "certifications", "invoice", "receipt",
]
SIGNATURE_WORDS = ["توقيع", "التوقيع", "signature", "signatures", "signed by", "معتمد", "ختم"]
TITLE_STOPS = ["page", "صفحة", "http", "date", "تاريخ"]

# Corrections of recognised Arabic.
HEADER_PATTERNS = [
    r"(?:جمهو|جمعو|جهود|جمهز|جمهذ|جمع|جمو|هوز|نههو|نهز|مهو|كزه|كنذ)[^\n]{0,35}(?:بينمنا|بينا|بيغنما|للجمعية|العربية|العربيه|مصر|صنالج|صزالح|صزالع|خنالع|خنالح|تذف|كنذف|مصير|العزيز)",
    r"(?<![\p{L}\p{N}_])(?:صنالج|صزالح|صزالع|خنالع|خنالح|كنذف|بينمنا|بيغنما)(?![\p{L}\p{N}_])",
    r"(?:نههوز|هوزكز|جمهوز|جمعوز)[^\n]{0,25}(?:بينا|بينمنا|صزالح|صنالج|صزالع)",
    r"جمهورية\s*مصر",
]
CARD_PATTERNS = [
    r"^(?:بطاق[ةه]|نطاق[ةه]|بطا[ف|ق][ةه]|بطافه)\s*(?:تحقيق|تحديق|تحفيق)?\s*(?:الشخصي[ةه]|الشخصيه|الشخصية)", r"^(?:تحقيق\s+الشخصي[ةه])", r"^(?:بطاقة\s*تحقيق|بطاقه\s*تحقيق)", r"^بطاق[ةه]\s+الشخصي[ةه](?![\p{L}\p{N}_])",
]
CARD_WORDS = ["بطاقة", "بطاقه", "تحقيق", "الشخصية", "الشخصيه"]
HEADER, CARD_TITLE = "جمهورية مصر العربية", "بطاقة تحقيق الشخصية"
NAME_REPAIRS = {
    "محمل": "محمد", "أحمل": "أحمد", "احمل": "أحمد", "محمول": "محمود", "سعيل": "سعيد", "ماجل": "ماجد", "خالل": "خالد", "خالـل": "خالد", "وليل": "وليد", "مجل": "مجد",
    "مرال": "مراد", "سعل": "سعد", "راشل": "راشد", "زاهل": "زاهد", "طارف": "طارق", "صالـح": "صالح", "ابراهيم": "إبراهيم", "اسماعيل": "إسماعيل", "ايمن": "أيمن", "اشرف": "أشرف",
}
PLACE_REPAIRS = {
    "الاسكندرية": "الإسكندرية", "الاسكندريه": "الإسكندرية", "القاهره": "القاهرة", "الجيزه": "الجيزة", "الدقهليه": "الدقهلية", "الشرقيه": "الشرقية", "القليوبيه": "القليوبية", "كفرالشيخ": "كفر الشيخ",
    "الغربيه": "الغربية", "المنوفيه": "المنوفية", "البحيره": "البحيرة", "الاسماعيليه": "الإسماعيلية", "الاسماعيلية": "الإسماعيلية", "بنى سويف": "بني سويف", "اسيوط": "أسيوط", "اسوان": "أسوان",
    "الاقصر": "الأقصر", "البحر الاحمر": "البحر الأحمر", "الوادى الجديد": "الوادي الجديد",
}
ABD_NAMES = (
    "الشفيع الرحمن الله الرحيم العزيز الكريم الفتاح الوهاب الرزاق العليم السميع البصير الحكيم القدوس السلام المؤمن المهيمن الجبار المتكبر الخالق الغفار القادر المجيد الودود الرؤوف الصبور الحميد "
    "المجيب الواسع المتين الوكيل الحي القيوم الباسط المعز المذل العدل اللطيف الخبير الحليم العظيم الغفور الشكور العلي الكبير الحفيظ المقيت الحسيب الجليل"
).split()

# Patterns of entities, with the boundaries of words written by the engine at hand.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}"
URL = r"(?:https?://|www\.)[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:/[^\s]*)?"
PHONE_MOBILE, PHONE_INTERNATIONAL = r"(?:\+?20\s?|0020\s?|0)?(?:10|11|12|15)\d{8}", r"\+?[1-9]\d{1,3}[-.\s]?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}"
DATE = r"(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
CURRENCY = r"(?:EGP|USD|EUR|GBP|SAR|AED|LE|L\.E|ج\.م|جنيه|دولار|ريال|درهم)"
VALID_EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,7}$"

# Labels of birth dates, and words in the headers of item tables, in the order in which they are tried.
BIRTH_LABELS = ["تاريخ الميلاد", "dob", "birth", "date of birth"]
ITEM_HEADERS = {
    "description": ["item", "desc", "الصنف", "الوصف", "بيان"],
    "quantity": ["qty", "quantity", "الكمية", "عدد"],
    "unit_price": ["price", "unit", "سعر", "فردي"],
    "amount": ["total", "amount", "الإجمالي", "قيمة"],
}
