"""Voice catalogue: fixed values that must equal the service's."""

# Express-as styles of most expressive single-locale voices.
STANDARD = "angry cheerful excited friendly hopeful sad shouting terrified unfriendly whispering"

DEFAULT_VOICE = "en-US-AvaMultilingualNeural"

# Id, label, locale, gender, style, expressiveness, recommended styles, express-as styles.
VOICES = [
    ("en-US-AvaMultilingualNeural", "Ava (US, Female, Expressive)", "en-US", "female", "expressive", 0.92, "natural conversational dramatic gentle", ""),
    ("en-US-AndrewMultilingualNeural", "Andrew (US, Male, Warm)", "en-US", "male", "warm", 0.88, "natural conversational gentle dramatic", ""),
    ("en-US-EmmaMultilingualNeural", "Emma (US, Female, Friendly)", "en-US", "female", "friendly", 0.86, "natural conversational gentle", ""),
    ("en-US-AriaNeural", "Aria (US, Female, Conversational)", "en-US", "female", "conversational", 0.9, "conversational natural gentle dramatic", "chat customerservice narration-professional newscast-casual newscast-formal cheerful empathetic angry sad excited friendly terrified shouting unfriendly whispering hopeful"),
    ("en-US-BrianMultilingualNeural", "Brian (US, Male, Calm)", "en-US", "male", "calm", 0.82, "natural gentle calm", ""),
    ("en-US-GuyNeural", "Guy (US, Male, Narrator)", "en-US", "male", "narrator", 0.78, "natural dramatic intense", "newscast angry cheerful sad excited friendly terrified shouting unfriendly whispering hopeful"),
    ("en-US-JennyNeural", "Jenny (US, Female, Narrator)", "en-US", "female", "narrator", 0.79, "natural conversational gentle", "assistant chat customerservice newscast angry cheerful sad excited friendly terrified shouting unfriendly whispering hopeful"),
    ("en-US-TonyNeural", "Tony (US, Male, Storyteller)", "en-US", "male", "storyteller", 0.84, "natural dramatic conversational", STANDARD),
    ("en-US-DavisNeural", "Davis (US, Male, Newscaster)", "en-US", "male", "newscaster", 0.71, "natural intense", "chat angry cheerful excited friendly hopeful sad shouting terrified unfriendly whispering"),
    ("en-US-JaneNeural", "Jane (US, Female, Bright)", "en-US", "female", "bright", 0.77, "natural conversational excited", STANDARD),
    ("en-US-SaraNeural", "Sara (US, Female, Warm)", "en-US", "female", "warm", 0.8, "natural conversational gentle", STANDARD),
    ("en-US-NancyNeural", "Nancy (US, Female, Expressive)", "en-US", "female", "expressive", 0.82, "natural dramatic conversational", STANDARD),
    ("en-US-ChristopherNeural", "Christopher (US, Male, Deep Narrator)", "en-US", "male", "narrator", 0.78, "natural dramatic intense", STANDARD),
    ("en-US-EricNeural", "Eric (US, Male, Mature)", "en-US", "male", "mature", 0.74, "natural dramatic", STANDARD),
    ("en-US-RogerNeural", "Roger (US, Male, Clear)", "en-US", "male", "clear", 0.73, "natural conversational", STANDARD),
    ("en-US-SteffanNeural", "Steffan (US, Male, Documentary)", "en-US", "male", "documentary", 0.75, "natural dramatic intense", STANDARD),
    ("en-GB-SoniaNeural", "Sonia (GB, Female, Natural)", "en-GB", "female", "natural", 0.85, "natural gentle conversational", "cheerful sad"),
    ("en-GB-RyanNeural", "Ryan (GB, Male, Natural)", "en-GB", "male", "natural", 0.83, "natural dramatic gentle", "cheerful chat whispering sad"),
    ("en-GB-LibbyNeural", "Libby (GB, Female, Friendly)", "en-GB", "female", "friendly", 0.8, "conversational gentle natural", ""),
    ("en-GB-ThomasNeural", "Thomas (GB, Male, Natural)", "en-GB", "male", "natural", 0.78, "natural dramatic conversational", ""),
    ("en-GB-MaisieNeural", "Maisie (GB, Female, Young)", "en-GB", "female", "young", 0.76, "natural conversational gentle", ""),
    ("en-AU-NatashaNeural", "Natasha (AU, Female)", "en-AU", "female", "natural", 0.76, "natural conversational gentle", ""),
    ("en-AU-WilliamNeural", "William (AU, Male)", "en-AU", "male", "natural", 0.74, "natural dramatic", ""),
    ("en-IE-ConnorNeural", "Connor (IE, Male)", "en-IE", "male", "natural", 0.75, "natural intense conversational", ""),
    ("en-IE-EmilyNeural", "Emily (IE, Female)", "en-IE", "female", "natural", 0.77, "natural gentle", ""),
    ("en-IN-NeerjaNeural", "Neerja (IN, Female)", "en-IN", "female", "natural", 0.73, "natural conversational", "cheerful empathetic newscast"),
    ("en-IN-PrabhatNeural", "Prabhat (IN, Male)", "en-IN", "male", "natural", 0.71, "natural dramatic", ""),
    ("es-ES-ElviraNeural", "Elvira (ES, Female)", "es-ES", "female", "natural", 0.68, "natural conversational", ""),
    ("es-MX-DaliaNeural", "Dalia (MX, Female)", "es-MX", "female", "natural", 0.67, "natural gentle", ""),
    ("fr-FR-DeniseNeural", "Denise (FR, Female)", "fr-FR", "female", "natural", 0.7, "natural conversational gentle", ""),
    ("fr-FR-HenriNeural", "Henri (FR, Male)", "fr-FR", "male", "natural", 0.69, "natural dramatic", ""),
    ("de-DE-KatjaNeural", "Katja (DE, Female)", "de-DE", "female", "natural", 0.66, "natural intense", ""),
    ("de-DE-ConradNeural", "Conrad (DE, Male)", "de-DE", "male", "natural", 0.65, "natural dramatic", ""),
    ("it-IT-ElsaNeural", "Elsa (IT, Female)", "it-IT", "female", "natural", 0.72, "natural conversational gentle", ""),
    ("pt-BR-FranciscaNeural", "Francisca (BR, Female)", "pt-BR", "female", "natural", 0.71, "natural conversational", ""),
    ("ja-JP-NanamiNeural", "Nanami (JP, Female)", "ja-JP", "female", "natural", 0.64, "natural gentle", ""),
    ("ko-KR-SunHiNeural", "Sun-Hi (KR, Female)", "ko-KR", "female", "natural", 0.63, "natural conversational", ""),
    ("zh-CN-XiaoxiaoNeural", "Xiaoxiao (CN, Female)", "zh-CN", "female", "natural", 0.7, "natural gentle dramatic", STANDARD),
    ("zh-CN-YunxiNeural", "Yunxi (CN, Male)", "zh-CN", "male", "natural", 0.68, "natural intense", STANDARD),
]

# Voices given to detected characters, in order.
CHARACTER_POOL = [
    "en-US-AndrewMultilingualNeural|pitch=+0Hz",
    "en-GB-SoniaNeural|pitch=+4Hz",
    "en-US-BrianMultilingualNeural|pitch=+3Hz",
    "en-AU-NatashaNeural|pitch=+3Hz",
    "en-GB-RyanNeural|pitch=-6Hz",
    "en-US-EmmaMultilingualNeural|pitch=+5Hz",
    "en-IE-ConnorNeural|pitch=-2Hz",
    "en-GB-LibbyNeural|pitch=+6Hz",
    "en-US-SteffanNeural|pitch=-8Hz",
    "en-NZ-MollyNeural|pitch=+4Hz",
    "en-US-ChristopherNeural|pitch=-4Hz",
    "en-CA-ClaraNeural|pitch=+2Hz",
]

# For a wanted style, the supported style to use instead, first that the voice has.
STYLE_FALLBACKS = {
    "empathetic": "empathetic sad friendly gentle calm",
    "gentle": "empathetic friendly calm hopeful",
    "calm": "empathetic friendly hopeful",
    "narration-professional": "narration-professional friendly chat calm",
    "narration": "narration-professional friendly chat",
    "intense": "angry shouting terrified",
    "dramatic": "narration-professional sad friendly cheerful",
    "excited": "excited cheerful hopeful",
    "cheerful": "cheerful excited friendly hopeful",
    "sad": "sad empathetic unfriendly",
    "angry": "angry shouting unfriendly",
    "terrified": "terrified shouting sad",
    "whispering": "whispering",
    "shouting": "shouting angry excited",
    "friendly": "friendly cheerful hopeful",
    "hopeful": "hopeful cheerful friendly",
    "sarcastic": "unfriendly friendly",
    "reflective": "empathetic friendly calm",
    "urgent": "shouting angry excited",
}
