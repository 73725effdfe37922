"""Word lists and patterns of the recipe vocabulary. All entries are fixed values that decide results."""

# Seasonings and pantry basics, left out of price decisions.
SEASONINGS = (
    "소금 꽃소금 맛소금 굵은소금 천일염 설탕 흑설탕 황설탕 물 간장 진간장 국간장 양조간장 조림간장 맛간장 저염간장 참기름 들기름 식용유 "
    "포도씨유 카놀라유 올리브유 올리브오일 후추 후춧가루 통후추 깨 통깨 깨소금 참깨 볶은깨 고추장 된장 쌈장 춘장 올리고당 물엿 조청 꿀 "
    "굴소스 맛술 미림 청주 소주 식초 사과식초 매실액 매실청 마요네즈 케첩 케찹 토마토케첩 머스타드 머스터드 다시다 소고기다시다 치킨스톡 "
    "미원 연두 액젓 멸치액젓 까나리액젓 피시소스 새우젓 고춧가루 고추가루 전분 감자전분 녹말 녹말가루 전분가루 부침가루 튀김가루 빵가루 "
    "카레가루 고추기름 레몬즙 파슬리 파슬리가루 생강가루 마늘가루 계피가루 버터 육수 멸치육수 다시마육수 얼음 얼음물 찬물 기름 식용류 "
    "해바라기유 매실액기스 검은깨 월계수잎 페페론치노 두반장 쌀뜨물 다시물 깨가루 후추가루 맛소금 설탕물 뜨거운물 우스터소스 돈까스소스 "
    "스테비아 알룰로스 데리야끼소스 스리라차 핫소스 쯔유 혼다시 가쓰오부시 와사비 연겨자 겨자 머스타드소스 바질"
).split()

# Endings that mark a seasoning, and the names they do not apply to.
SEASONING_ENDINGS = ("소스", "액젓", "가루", "육수", "오일", "간장", "식초", "시럽")
NOT_SEASONING = ("김가루", "콩가루", "들깨가루")

# Priced item -> names it goes by in recipes.
FRESH_ALIASES = {
    "계란": ["계란", "달걀", "메추리알"], "우유": ["우유"],
    "소": ["소고기", "쇠고기", "한우", "차돌", "우삼겹", "불고기용", "국거리", "사태", "양지", "등심", "안심", "채끝", "부채살", "다짐육",
          "다진소고기", "소불고기"],
    "돼지": ["돼지고기", "삼겹살", "목살", "앞다리", "뒷다리", "대패", "돈육", "다진돼지고기", "돼지갈비", "항정"],
    "닭": ["닭", "닭고기", "닭가슴살", "닭다리", "닭안심", "닭봉", "닭날개"],
    "파": ["다진파", "대파", "쪽파", "실파", "파"], "깐마늘(국산)": ["다진마늘", "마늘", "편마늘", "통마늘", "마늘쫑"],
    "풋고추": ["청양고추", "청량고추", "땡초", "풋고추", "꽈리고추", "청고추", "오이고추", "고추"],
    "붉은고추": ["홍고추", "붉은고추"], "호박": ["애호박", "단호박", "호박"], "생강": ["생강", "다진생강"], "물오징어": ["오징어"],
    "마른오징어": ["진미채", "마른오징어"], "마른멸치": ["멸치", "잔멸치", "볶음멸치", "국물멸치"], "건다시마": ["다시마"],
    "마른미역": ["미역"], "북어": ["북어", "황태"], "명태": ["동태", "명태", "코다리"], "새우": ["새우", "칵테일새우", "냉동새우"],
    "굴": ["굴", "생굴"], "김": ["김가루", "조미김", "김밥김", "김"],
    "쌀": ["쌀", "밥", "햅쌀", "찬밥", "공기밥", "즉석밥", "햇반"], "느타리버섯": ["느타리"], "팽이버섯": ["팽이"],
    "새송이버섯": ["새송이"], "배추": ["알배추", "알배기배추", "배추"], "무": ["무"], "콩": ["콩", "서리태", "검은콩"],
    "토마토": ["토마토"], "방울토마토": ["방울토마토"],
}

# Names that must not be read as a fresh item.
NOT_FRESH = (
    "배추김치", "김치", "묵은지", "깍두기", "콩나물", "숙주", "두부", "순두부", "연두부", "콩가루", "무말랭이", "단무지", "파프리카가루",
    "파슬리", "파마산", "파스타", "파래", "김치국물", "깻잎김치", "호박잎", "쌀국수", "쌀떡", "떡", "떡국떡", "떡볶이떡", "밥솥", "흰밥", "무순",
    "새우젓", "멸치액젓", "어묵", "맛살", "게맛살", "다시마육수", "멸치육수", "미역줄기",
)
KIMCHI = "김치"

# Packaged food -> (words in the recipe, words in the product list).
PACKAGED = {
    "두부": (["두부", "순두부", "연두부"], ["두부"]), "콩나물": (["콩나물", "숙주"], ["콩나물"]),
    "김치": (["김치", "묵은지", "배추김치"], ["포기김치", "배추김치"]), "어묵": (["어묵"], ["어묵"]),
    "맛살": (["맛살", "게맛살", "크래미"], ["맛살"]),
    "햄": (["햄", "스팸", "베이컨", "소시지", "소세지", "비엔나"], ["햄", "스팸", "베이컨", "소시지"]),
    "참치": (["참치"], ["참치"]), "만두": (["만두"], ["만두"]), "라면": (["라면", "라면사리"], ["라면"]), "치즈": (["치즈"], ["치즈"]),
    "밀가루": (["밀가루", "중력분", "박력분"], ["밀가루"]), "국수": (["소면", "국수", "중면"], ["소면", "국수"]),
    "당면": (["당면"], ["당면"]), "떡": (["떡볶이떡", "떡국떡", "떡", "쌀떡"], ["떡볶이"]),
    "파스타": (["파스타", "스파게티"], ["스파게티", "파스타"]),
}

# Class and source names in the output tables.
CLASS_SEASONING, CLASS_FOOD = "양념", "식재료"
SOURCE_FRESH, SOURCE_PACKAGED, SOURCE_NONE = "신선식품", "생필품", "미연결"
EXCLUDED_MENU = "제외"

# Ingredient text patterns (brackets, trailing amounts, leading states, spaces) and the list separators.
ING_BRACKETS = r"\(.*?\)|\[.*?\]|<.*?>"
ING_TAIL = r"(약간|적당량|조금|기호에\s*따라|선택|옵션|생략가능|또는.*)$"
ING_HEAD = r"^(채썬|썬|삶은|데친|냉동|신선한|손질된|불린|말린|국산|수입산?)\s*"
ING_SEPARATORS = r"[,♣■:]"

# Endings of dish names.
DISH_WORDS = (
    "볶음밥", "비빔밥", "덮밥", "주먹밥", "김밥", "볶음", "조림", "장조림", "무침", "찌개", "전골", "국", "탕", "전", "부침", "구이", "찜", "밥",
    "국수", "라면", "우동", "면", "파스타", "스파게티", "리조또", "샐러드", "떡볶이", "볶이", "죽", "튀김", "스테이크", "토스트", "샌드위치",
    "피자", "카레", "짜글이", "나물", "쌈", "롤", "수프", "스프", "오믈렛", "말이", "동그랑땡", "꼬치", "냉채", "겉절이", "장아찌", "피클",
    "소박이", "김치", "빵", "케이크", "쿠키", "강정", "불고기", "육회", "오이지", "깐풍기", "소바", "브라우니", "푸딩", "쌈장", "어니언링",
    "깍두기", "절임", "잡채", "동파육", "타르트", "버거", "카나페", "부르스게타", "브루스케타", "크럼블", "오일파스타", "올리오", "볶음우동",
    "까스", "가스", "치킨", "볶음면", "비빔면", "냉면", "짬뽕", "짜장", "탕수육", "만두", "그라탕", "또띠아", "부리또", "타코", "핫도그", "와플",
)
NOT_DISH = ("버전", "완전", "도전", "사전", "충전", "설탕", "No설탕", "흑설탕", "전전", "원전", "발전", "대전", "고전", "야채", "채소")

# Words without meaning in titles, quoted spans, bracketed or tagged parts, token separators.
TITLE_NOISE = (
    r"초간단|간단|자취|혼밥|백종원|백주부|황금|레시피|만들기|만드는\s*법|끓이는\s*법|맛있게|맛있는|요리|반찬|메뉴|추천|꿀팁|비법|1인분|"
    r"한그릇|한끼|초스피드|야매|노오븐|신혼밥상|영상"
)
TITLE_QUOTED = r"[<\[【'\"‘“]\s*([^<>\[\]【】'\"‘’“”]{2,20}?)\s*[>\]】'\"’”]"
TITLE_ASIDE = r"\[.*?\]|\(.*?\)|【.*?】|<.*?>|#\S+"
TITLE_SPLIT = r"[^\w가-힣]+"

# Spellings unified in dish names, applied in this order.
SAME_DISH = (
    ("달걀", "계란"), ("오뎅", "어묵"), ("소세지", "소시지"), ("쏘야", "소시지야채볶음"), ("챱", "찹"), ("돈까스", "돈가스"),
    ("마늘종", "마늘쫑"), ("뭇국", "무국"), ("만둣국", "만두국"), ("닭도리탕", "닭볶음탕"), ("고추가루", "고춧가루"), ("스파게티", "파스타"),
)
