"""Small word lists for made-up values; extend or replace them to taste."""

WORDS = {
    "first": ["Ada", "Bela", "Cleo", "Dario", "Edda", "Femi", "Gita", "Hugo", "Ines", "Jonas", "Kira", "Leon", "Mina", "Noor", "Otis", "Pia"],
    "last": ["Abel", "Brand", "Costa", "Dorn", "Ekman", "Falk", "Grau", "Holm", "Iyer", "Jansen", "Kowal", "Lind", "Moreau", "Nagy", "Okafor", "Petrov"],
    "title": ["Dr", "Mr", "Mrs", "Ms", "Mx", "Prof"],
    "domain": ["example.com", "example.net", "example.org", "mail.example.com"],
    "street": ["Birch Lane", "Canal Road", "Dock Street", "Elm Avenue", "Forge Hill", "Grove Court", "High Street", "Inn Walk"],
    "city": ["Arden", "Birkfeld", "Corvale", "Dunmore", "Elmstad", "Farrow", "Glenby", "Harlow"],
    "region": ["Northmark", "Eastvale", "Southmoor", "Westfold"],
    "country": ["Austria", "Brazil", "Canada", "Denmark", "Egypt", "France", "Ghana", "Hungary"],
    "company_end": ["Group", "Inc", "Labs", "LLC", "Partners", "Works"],
    "department": ["Finance", "Legal", "Operations", "People", "Research", "Sales", "Support"],
    "job_level": ["Junior", "Senior", "Lead", "Chief"],
    "job": ["Analyst", "Engineer", "Designer", "Planner", "Auditor", "Editor"],
    "currency": ["EUR", "USD", "GBP", "JPY", "CHF", "SEK", "PLN", "BRL"],
    "word": ["amber", "basil", "cedar", "delta", "ember", "fjord", "gravel", "harbor", "indigo", "juniper", "kelp", "lumen", "maple", "nectar", "onyx", "prairie"],
    "product": ["Lamp", "Kettle", "Chair", "Desk", "Basket", "Clock", "Mirror", "Shelf"],
    "adjective": ["Bright", "Calm", "Dense", "Eager", "Fine", "Grand", "Hollow", "Light"],
    "agent": ["Mozilla/5.0 (X11; Linux x86_64)", "Mozilla/5.0 (Macintosh)", "Mozilla/5.0 (Windows NT 10.0)"],
    "extension": ["csv", "gif", "jpg", "json", "pdf", "png", "txt", "zip"],
    "mime": ["text/csv", "image/gif", "image/jpeg", "application/json", "application/pdf", "image/png", "text/plain", "application/zip"],
    "country_code": ["+1", "+33", "+44", "+46", "+48", "+49", "+55", "+81"],
}
