"""Sample invoices with known results (fixed values)."""

RECEIPT_1 = [
    "المونسيه.. طريق الثمامه",
    "الرقم الضريبي",
    "310227420600003",
    "Simplified Tax Invoice",
    "الطلب# ٦٩",
    "وقت الطباعة 2021/11/14 09:19:08",
    "استلام",
    "فاتورة# 101347",
    "وقت الطلب 2021/11/14 08:01:30",
    "المنشئ saeid",
    "المغلق saeid",
    "الكمية وحدة السعر",
    "1",
    "باباكا تشوكلت",
    "Babka Chocolate",
    "SAR 17.00",
    "1",
    "بودينغ القهوة والموز",
    "Pudding",
    "SAR 24.00",
    "1",
    "بسكت الجبن وال",
    "شبت",
    "Cheese-dill biscuit",
    "SAR 12.00",
    "1",
    "شريحة ك",
    "يكة التوت الأزرق",
    "slice of blue berry cake",
    "SAR 15.00",
    "1",
    "اسبريسو + حليب",
    "Espresso w/milk",
    "SAR 3.96",
    "Regular Temp, Full",
    "فلات وايت, Falt White",
    "Fat2",
    "1",
    "شاي أنجليزي",
    "English Brunch Tea",
    "SAR 15.00",
    "المجموع الفرعي",
    "SAR 86.96",
    "Subtotal",
    "ضريبة القيمة المضافة (15.0%) SAR 13.04",
    "الإجمالي SAR 100.00",
    "Total",
    "شركة شفرة نحاسية لتقديم المشروبات",
    "الرقم الضريبي 310227420600003",
]

RECEIPT_2 = [
    "المونسيه.. طريق الثمامه",
    "الرقم الضريبي : 302281309900003",
    "Simplified Tax Invoice",
    "الطلب# 302",
    "وقت الطباعة: ١٢/١٢/٢٠٢٣ ١٥:٢٣:٠٤ م",
    "استلام",
    "فاتورة# 232130",
    "١٢/١٢/٢٠٢٣ ١٤:١٤:٤٣ م",
    "saeid :المنشئ",
    "saeid :المغلق",
    "الكمية وحدة السعر",
    "1 coffee day قهوه اليوم SAR 7.82",
    "1 Flat wight فلات وايت - SAR 13.91",
    "1 Dates cake.. كيكة التمر الايس كريم SAR 21.74",
    "with ice cream",
    "المجموع الفرعي SAR 43.47",
    "Subtotal",
    "(15.0%)ضريبة القيمة المضافة SAR 6.52",
    "التقريب SAR 0.01",
    "Rounding",
    "الإجمالي SAR 50.00",
    "Total",
    "الدفع - شبكة card SAR 50.00",
]

NOISY_FOOTER = [
    "المجموع الفرعي",
    "SAR 43.47",
    "Subtotal",
    "SAR 6.52",
    "١ضريبة القيمة المضافة",
    "التقريب",
    "SAR 0.01",
    "الإجمالي",
    "SAR 50.00",
]

FOOTER_ONLY = [
    "المجموع الفرعي SAR 43.47",
    "Subtotal",
    "ضريبة القيمة المضافة SAR 6.52",
    "التقريب SAR 0.01",
    "Rounding",
    "الإجمالي SAR 50.00",
    "Total",
    "الدفع SAR 50.00",
    "الرقم الضريبي 310227420600003",
]

ITEMS_THEN_FOOTER = RECEIPT_2[10:] + ["الرقم الضريبي 310227420600003"]

# a positioned table: text, confidence, x1, y1
POSITIONED = [
    ("فاتورة ضريبية", 0.99, 50, 30),
    ("المورد: شركة النجم للمستلزمات المكتبية", 0.98, 50, 60),
    ("الرقم الضريبي: 300987654300003", 0.97, 50, 90),
    ("رقم الفاتورة: INV-2025-00001", 0.98, 50, 120),
    ("التاريخ: 2025-11-10", 0.99, 50, 150),
    ("الوصف", 0.99, 50, 185),
    ("الكمية", 0.99, 210, 185),
    ("سعر الوحدة", 0.99, 290, 185),
    ("الإجمالي", 0.99, 400, 185),
    ("أقلام حبر أسود باك 12 حبة", 0.95, 50, 215),
    ("3", 0.95, 210, 215),
    ("30.00", 0.95, 290, 215),
    ("90.00", 0.95, 400, 215),
    ("دفاتر ملاحظات A4 سلك", 0.95, 50, 245),
    ("4", 0.95, 210, 245),
    ("20.00", 0.95, 290, 245),
    ("80.00", 0.95, 400, 245),
    ("ورق طباعة A4 رزمة 500 ورقة", 0.96, 50, 275),
    ("2", 0.96, 210, 275),
    ("40.00", 0.96, 290, 275),
    ("80.00", 0.96, 400, 275),
    ("المجموع قبل الضريبة: 250.00 ريال", 0.98, 50, 330),
    ("ضريبة القيمة المضافة (15%): 37.50 ريال", 0.97, 50, 360),
    ("الإجمالي المستحق: 287.50 ريال سعودي", 0.98, 50, 390),
]
