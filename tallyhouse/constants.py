"""Fixed values that results depend on."""

# Fixed value: accepted mobile number format (the comma inside the class is part of the format).
PHONE_PATTERN = r"^(13[0-9]|14[579]|15[0-3,5-9]|16[6]|17[0135678]|18[0-9]|19[89])\d{8}$"

# Fixed value: invitations before 2019-03-16 00:00 Asia/Shanghai always count as rewarded.
REWARD_START = 1552665600
# Days an invited company / friend has to pass verification, in seconds.
COMPANY_REWARD_WINDOW = 5184000
FRIEND_REWARD_WINDOW = 2592000

# Fixed value: the business time zone for day buckets.
TIME_ZONE = "Asia/Shanghai"

# Labels of one-character company rights (codes 4 and 6 have no label).
RIGHT_LABELS = {
    "1": "超级管理员",
    "2": "高级管理员",
    "3": "订单",
    "5": "采购",
    "7": "生产",
    "8": "权限管理",
    "9": "仓库",
}

# The rights that a company admin may be given.
EDITABLE_RIGHTS = {"3": "订单", "5": "采购", "7": "生产", "8": "权限管理", "9": "仓库"}

# The five capabilities of the company self-assessment.
CAPABILITY_LABELS = {
    "1": "数据可视化",
    "2": "数据分析",
    "3": "机器代替人工",
    "4": "机器远程控制",
    "5": "智能预测、预警",
}
CAPABILITY_DONE = "（完善）"
CAPABILITY_MISSING = "（欠缺）"

# Words used in report rows and stored review notes.
INCOME = "收入"
EXPENSE = "支出"
MATERIAL = "物料"
PRODUCT = "产品"
STOCK_IN = "入库"
STOCK_OUT = "出库"
PLAIN_ADMIN = "普通管理员"
SUPER_ADMIN = "超级管理员"
REVIEW_PASSED = "认证通过"
REVIEW_FAILED = "认证未通过"

# Where image ids become URLs; a deployment passes its own.
IMAGE_BASE = "https://images.example.com/"
