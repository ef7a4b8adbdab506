"""The sample lake: six small tables with known answers, and their loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.sources import schemas
from tarnlake.sources.catalog import create_database, create_table
from tarnlake.sources.tables import literal_rows, replace_partitions, replace_table

# Fixed values. The rows below are the sample lake itself: the answers of the reports and audits
# over it are known, so every value has to stay as it is.

DATABASE_COMMENTS = {"hive_db": "E-commerce data lake for ClickHouse integration"}

EMPLOYEES = [
    (1, "Takeshi Yamamoto", "Engineering", 92500.0, "2021-03-15"),
    (2, "Priya Sharma", "Data Science", 88000.0, "2020-07-22"),
    (3, "Marcus Weber", "Engineering", 95800.0, "2019-11-08"),
    (4, "Liu Mei", "Analytics", 76300.0, "2022-01-14"),
    (5, "Sofia Rodriguez", "Engineering", 101200.0, "2018-06-30"),
    (6, "Andrei Volkov", "Data Science", 83700.0, "2021-09-02"),
    (7, "Fatima Al-Hassan", "Analytics", 79500.0, "2020-04-18"),
    (8, "Chen Wei", "Engineering", 97100.0, "2019-02-25"),
]

USER_PROFILES = [
    (1, "zhang_wei", "M", 32, "Beijing", "Beijing", "2022-03-10", "gold", 28650.0),
    (2, "li_na", "F", 27, "Shanghai", "Shanghai", "2022-05-18", "silver", 12300.0),
    (3, "wang_fang", "F", 35, "Guangzhou", "Guangdong", "2021-11-02", "platinum", 76500.0),
    (4, "chen_bo", "M", 29, "Shenzhen", "Guangdong", "2023-01-08", "bronze", 3200.0),
    (5, "liu_yang", "M", 41, "Chengdu", "Sichuan", "2021-07-15", "gold", 42100.0),
    (6, "zhao_min", "F", 24, "Hangzhou", "Zhejiang", "2023-06-20", "bronze", 1850.0),
    (7, "sun_jie", "M", 38, "Wuhan", "Hubei", "2021-09-11", "silver", 18900.0),
    (8, "zhou_xin", "F", 31, "Nanjing", "Jiangsu", "2022-08-03", "gold", 35600.0),
    (9, "wu_hao", "M", 26, "Xian", "Shaanxi", "2023-02-14", "bronze", 2700.0),
    (10, "zheng_ling", "F", 44, "Chongqing", "Chongqing", "2020-12-25", "platinum", 98300.0),
    (11, "huang_tao", "M", 33, "Tianjin", "Tianjin", "2022-04-07", "silver", 21400.0),
    (12, "xu_mei", "F", 28, "Suzhou", "Jiangsu", "2022-10-19", "gold", 31800.0),
    (13, "zhu_gang", "M", 36, "Qingdao", "Shandong", "2021-06-30", "silver", 16500.0),
    (14, "he_shan", "F", 22, "Xiamen", "Fujian", "2023-08-11", "bronze", 980.0),
    (15, "gao_peng", "M", 45, "Zhengzhou", "Henan", "2020-09-05", "platinum", 112000.0),
]

# order_id, user_id, product_id, quantity, unit_price, discount_amount, total_amount, status,
# payment_method, city, province, created_at
ORDERS = [
    ("ORD-20240101-001", 3, 2, 1, 5999.0, 300.0, 5699.0, "completed", "alipay", "Guangzhou", "Guangdong", "2024-01-01 09:12:33"),
    ("ORD-20240102-001", 8, 5, 2, 199.0, 0.0, 398.0, "completed", "wechat", "Nanjing", "Jiangsu", "2024-01-02 14:05:20"),
    ("ORD-20240103-001", 1, 1, 1, 12999.0, 1000.0, 11999.0, "completed", "creditcard", "Beijing", "Beijing", "2024-01-03 10:30:15"),
    ("ORD-20240103-002", 5, 8, 3, 89.0, 0.0, 267.0, "completed", "alipay", "Chengdu", "Sichuan", "2024-01-03 16:48:02"),
    ("ORD-20240104-001", 10, 3, 1, 8999.0, 500.0, 8499.0, "shipped", "banktransfer", "Chongqing", "Chongqing", "2024-01-04 11:22:44"),
    ("ORD-20240105-001", 2, 6, 2, 349.0, 30.0, 668.0, "completed", "wechat", "Shanghai", "Shanghai", "2024-01-05 09:55:31"),
    ("ORD-20240106-001", 7, 4, 1, 3299.0, 200.0, 3099.0, "completed", "alipay", "Wuhan", "Hubei", "2024-01-06 13:17:08"),
    ("ORD-20240107-001", 4, 9, 5, 59.0, 0.0, 295.0, "cancelled", "wechat", "Shenzhen", "Guangdong", "2024-01-07 08:40:55"),
    ("ORD-20240108-001", 12, 7, 2, 599.0, 50.0, 1148.0, "completed", "creditcard", "Suzhou", "Jiangsu", "2024-01-08 15:33:27"),
    ("ORD-20240109-001", 15, 2, 1, 5999.0, 600.0, 5399.0, "completed", "alipay", "Zhengzhou", "Henan", "2024-01-09 10:05:19"),
    ("ORD-20240110-001", 6, 10, 1, 2499.0, 100.0, 2399.0, "completed", "wechat", "Hangzhou", "Zhejiang", "2024-01-10 18:22:41"),
    ("ORD-20240110-002", 11, 1, 1, 12999.0, 1200.0, 11799.0, "shipped", "banktransfer", "Tianjin", "Tianjin", "2024-01-10 19:01:58"),
    ("ORD-20240112-001", 3, 5, 4, 199.0, 0.0, 796.0, "completed", "alipay", "Guangzhou", "Guangdong", "2024-01-12 11:44:16"),
    ("ORD-20240115-001", 5, 3, 1, 8999.0, 450.0, 8549.0, "refunded", "creditcard", "Chengdu", "Sichuan", "2024-01-15 14:29:03"),
    ("ORD-20240118-001", 9, 6, 1, 349.0, 0.0, 349.0, "completed", "wechat", "Xian", "Shaanxi", "2024-01-18 09:18:37"),
    ("ORD-20240120-001", 13, 4, 2, 3299.0, 300.0, 6298.0, "completed", "alipay", "Qingdao", "Shandong", "2024-01-20 16:55:21"),
    ("ORD-20240122-001", 1, 8, 10, 89.0, 50.0, 840.0, "completed", "alipay", "Beijing", "Beijing", "2024-01-22 10:12:44"),
    ("ORD-20240125-001", 8, 2, 1, 5999.0, 300.0, 5699.0, "pending", "creditcard", "Nanjing", "Jiangsu", "2024-01-25 17:38:09"),
    ("ORD-20240128-001", 14, 7, 1, 599.0, 0.0, 599.0, "completed", "wechat", "Xiamen", "Fujian", "2024-01-28 08:50:22"),
    ("ORD-20240130-001", 10, 1, 1, 12999.0, 1500.0, 11499.0, "completed", "banktransfer", "Chongqing", "Chongqing", "2024-01-30 13:25:47"),
    ("ORD-20240201-001", 2, 9, 2, 59.0, 0.0, 118.0, "completed", "wechat", "Shanghai", "Shanghai", "2024-02-01 10:00:00"),
    ("ORD-20240203-001", 5, 3, 1, 8999.0, 450.0, 8549.0, "completed", "alipay", "Chengdu", "Sichuan", "2024-02-03 14:22:11"),
    ("ORD-20240204-001", 7, 6, 3, 349.0, 30.0, 1017.0, "shipped", "creditcard", "Wuhan", "Hubei", "2024-02-04 09:15:38"),
    ("ORD-20240205-001", 12, 1, 1, 12999.0, 1200.0, 11799.0, "completed", "banktransfer", "Suzhou", "Jiangsu", "2024-02-05 11:40:27"),
    ("ORD-20240207-001", 3, 5, 5, 199.0, 0.0, 995.0, "completed", "wechat", "Guangzhou", "Guangdong", "2024-02-07 16:08:53"),
    ("ORD-20240209-001", 1, 4, 1, 3299.0, 200.0, 3099.0, "completed", "alipay", "Beijing", "Beijing", "2024-02-09 10:35:14"),
    ("ORD-20240210-001", 15, 2, 2, 5999.0, 600.0, 11398.0, "completed", "creditcard", "Zhengzhou", "Henan", "2024-02-10 14:51:06"),
    ("ORD-20240212-001", 6, 8, 3, 89.0, 0.0, 267.0, "cancelled", "alipay", "Hangzhou", "Zhejiang", "2024-02-12 08:22:39"),
    ("ORD-20240214-001", 8, 10, 1, 2499.0, 100.0, 2399.0, "completed", "wechat", "Nanjing", "Jiangsu", "2024-02-14 18:00:05"),
    ("ORD-20240215-001", 11, 7, 2, 599.0, 50.0, 1148.0, "completed", "alipay", "Tianjin", "Tianjin", "2024-02-15 12:17:43"),
    ("ORD-20240218-001", 4, 3, 1, 8999.0, 0.0, 8999.0, "pending", "banktransfer", "Shenzhen", "Guangdong", "2024-02-18 09:45:21"),
    ("ORD-20240220-001", 9, 6, 2, 349.0, 30.0, 668.0, "completed", "wechat", "Xian", "Shaanxi", "2024-02-20 15:33:08"),
    ("ORD-20240222-001", 13, 5, 3, 199.0, 0.0, 597.0, "completed", "creditcard", "Qingdao", "Shandong", "2024-02-22 11:28:34"),
    ("ORD-20240225-001", 10, 1, 1, 12999.0, 1500.0, 11499.0, "completed", "alipay", "Chongqing", "Chongqing", "2024-02-25 16:44:17"),
    ("ORD-20240228-001", 2, 4, 1, 3299.0, 200.0, 3099.0, "refunded", "wechat", "Shanghai", "Shanghai", "2024-02-28 10:05:59"),
    ("ORD-20240301-001", 5, 2, 1, 5999.0, 300.0, 5699.0, "completed", "alipay", "Chengdu", "Sichuan", "2024-03-01 09:30:00"),
    ("ORD-20240303-001", 1, 8, 5, 89.0, 0.0, 445.0, "completed", "wechat", "Beijing", "Beijing", "2024-03-03 14:18:22"),
    ("ORD-20240305-001", 3, 1, 1, 12999.0, 1000.0, 11999.0, "shipped", "creditcard", "Guangzhou", "Guangdong", "2024-03-05 11:55:41"),
    ("ORD-20240308-001", 12, 3, 1, 8999.0, 450.0, 8549.0, "completed", "banktransfer", "Suzhou", "Jiangsu", "2024-03-08 16:37:09"),
    ("ORD-20240310-001", 7, 9, 8, 59.0, 0.0, 472.0, "completed", "alipay", "Wuhan", "Hubei", "2024-03-10 08:44:55"),
    ("ORD-20240312-001", 15, 4, 2, 3299.0, 300.0, 6298.0, "completed", "wechat", "Zhengzhou", "Henan", "2024-03-12 13:22:30"),
    ("ORD-20240315-001", 8, 6, 1, 349.0, 0.0, 349.0, "completed", "creditcard", "Nanjing", "Jiangsu", "2024-03-15 10:09:17"),
    ("ORD-20240318-001", 10, 5, 6, 199.0, 50.0, 1144.0, "completed", "alipay", "Chongqing", "Chongqing", "2024-03-18 15:50:48"),
    ("ORD-20240320-001", 4, 7, 2, 599.0, 50.0, 1148.0, "cancelled", "wechat", "Shenzhen", "Guangdong", "2024-03-20 17:15:03"),
    ("ORD-20240322-001", 11, 2, 1, 5999.0, 300.0, 5699.0, "completed", "banktransfer", "Tianjin", "Tianjin", "2024-03-22 09:58:34"),
    ("ORD-20240325-001", 6, 10, 2, 2499.0, 200.0, 4598.0, "completed", "alipay", "Hangzhou", "Zhejiang", "2024-03-25 14:31:21"),
    ("ORD-20240328-001", 9, 3, 1, 8999.0, 0.0, 8999.0, "pending", "creditcard", "Xian", "Shaanxi", "2024-03-28 11:47:09"),
    ("ORD-20240330-001", 13, 1, 1, 12999.0, 1200.0, 11799.0, "completed", "wechat", "Qingdao", "Shandong", "2024-03-30 16:22:55"),
    ("ORD-20240331-001", 2, 4, 3, 3299.0, 450.0, 9447.0, "shipped", "alipay", "Shanghai", "Shanghai", "2024-03-31 08:33:40"),
    ("ORD-20240331-002", 14, 5, 2, 199.0, 0.0, 398.0, "completed", "wechat", "Xiamen", "Fujian", "2024-03-31 19:10:28"),
]

PRODUCTS = [
    (1001, "华为 Mate 60 Pro", 1, "华为", 6999.0, 5200.0, 850, 4.8, 12580, True, "2023-09-01"),
    (1002, "苹果 iPhone 15 Pro", 1, "苹果", 8999.0, 6100.0, 640, 4.7, 9870, True, "2023-09-22"),
    (1003, "小米 14", 1, "小米", 3999.0, 2800.0, 1200, 4.6, 7620, True, "2023-10-26"),
    (1004, "OPPO Find X7", 1, "OPPO", 4499.0, 3100.0, 560, 4.5, 4230, True, "2023-12-12"),
    (1005, "vivo X100 Pro", 1, "vivo", 4999.0, 3400.0, 480, 4.6, 3890, True, "2023-11-13"),
    (1006, "三星 Galaxy S24", 1, "三星", 5999.0, 4100.0, 320, 4.4, 2760, True, "2024-01-17"),
    (1007, "一加 12", 1, "一加", 3999.0, 2700.0, 290, 4.5, 2180, True, "2024-01-23"),
    (1008, "荣耀 Magic6 Pro", 1, "荣耀", 4999.0, 3300.0, 410, 4.5, 3150, True, "2024-01-10"),
    (1009, "红米 Note 13 Pro", 1, "小米", 1799.0, 1100.0, 3200, 4.4, 15600, True, "2023-09-21"),
    (1010, "真我 GT5 Pro", 1, "真我", 2999.0, 2000.0, 680, 4.3, 2890, True, "2023-12-07"),
    (2001, "联想小新 Pro 16", 2, "联想", 5999.0, 4200.0, 420, 4.5, 6780, True, "2023-08-15"),
    (2002, "苹果 MacBook Air M2", 2, "苹果", 8999.0, 6500.0, 280, 4.9, 8920, True, "2022-06-10"),
    (2003, "华为 MateBook X Pro", 2, "华为", 9999.0, 7100.0, 160, 4.7, 4560, True, "2023-09-28"),
    (2004, "戴尔 XPS 15", 2, "戴尔", 10999.0, 7800.0, 120, 4.6, 3240, True, "2023-10-05"),
    (2005, "惠普 ENVY 16", 2, "惠普", 7999.0, 5600.0, 200, 4.4, 2780, True, "2023-11-20"),
    (2006, "华硕 ROG 幻 16", 2, "华硕", 11999.0, 8500.0, 150, 4.7, 3560, True, "2023-09-10"),
    (2007, "雷蛇 灵刃 16", 2, "雷蛇", 14999.0, 10800.0, 80, 4.6, 1890, True, "2023-10-18"),
    (2008, "微软 Surface Pro 9", 2, "微软", 9999.0, 7200.0, 110, 4.5, 2340, True, "2022-10-12"),
    (3001, "索尼 WH-1000XM5 耳机", 3, "索尼", 2299.0, 1400.0, 780, 4.8, 18920, True, "2022-05-20"),
    (3002, "苹果 AirPods Pro 2", 3, "苹果", 1799.0, 1100.0, 1200, 4.7, 24680, True, "2022-09-07"),
    (3003, "华为 FreeBuds Pro 3", 3, "华为", 999.0, 580.0, 2100, 4.6, 12340, True, "2023-09-25"),
    (3004, "小米 Buds 4 Pro", 3, "小米", 599.0, 320.0, 3400, 4.4, 18760, True, "2022-10-11"),
    (3005, "Bose QuietComfort 45", 3, "Bose", 2699.0, 1800.0, 320, 4.7, 8920, True, "2021-09-23"),
    (3006, "JBL Charge 5 音箱", 3, "JBL", 899.0, 520.0, 980, 4.5, 14230, True, "2021-07-15"),
    (3007, "森海塞尔 Momentum 4", 3, "森海塞尔", 2499.0, 1650.0, 210, 4.8, 5670, True, "2022-09-29"),
    (4001, "戴森 V15 吸尘器", 4, "戴森", 4490.0, 2900.0, 560, 4.8, 32480, True, "2021-03-25"),
    (4002, "追觅 X30 扫地机器人", 4, "追觅", 3999.0, 2600.0, 420, 4.6, 18920, True, "2023-08-03"),
    (4003, "石头 G20 扫地机器人", 4, "石头科技", 3499.0, 2200.0, 380, 4.5, 15670, True, "2023-10-12"),
    (4004, "美的 空气净化器 KJ600", 4, "美的", 1999.0, 1200.0, 890, 4.4, 9870, True, "2023-05-15"),
    (4005, "飞利浦 空气净化器", 4, "飞利浦", 2499.0, 1600.0, 340, 4.5, 7650, True, "2022-11-08"),
    (4006, "海尔 冰箱 BCD-603", 4, "海尔", 5999.0, 3800.0, 180, 4.6, 5430, True, "2023-04-20"),
    (4007, "格力 空调 3匹", 4, "格力", 4999.0, 3100.0, 260, 4.7, 8920, True, "2023-02-28"),
    (5001, "耐克 Air Max 270", 5, "耐克", 899.0, 450.0, 1800, 4.5, 24680, True, "2023-01-15"),
    (5002, "阿迪达斯 Ultra Boost 23", 5, "阿迪达斯", 1099.0, 560.0, 1400, 4.6, 19870, True, "2023-02-20"),
    (5003, "李宁 驭帅 TD", 5, "李宁", 699.0, 320.0, 2200, 4.4, 32560, True, "2023-09-01"),
    (5004, "安踏 KT9 篮球鞋", 5, "安踏", 599.0, 280.0, 2800, 4.3, 28940, True, "2023-10-10"),
    (5005, "New Balance 574", 5, "New Balance", 599.0, 290.0, 1900, 4.5, 18760, True, "2023-03-15"),
]

DIM_CATEGORY = [
    (1, "手机", 0, 1, 1),
    (2, "笔记本电脑", 0, 1, 2),
    (3, "音频设备", 0, 1, 3),
    (4, "家用电器", 0, 1, 4),
    (5, "运动鞋", 0, 1, 5),
]

# event_id, user_id, product_id, event_type, session_id, duration_sec, source, device, ts
USER_BEHAVIOR = [
    ("ev_0001", 1, 1001, "view", "s001", 45, "search", "mobile", "2024-01-15 08:12:30"),
    ("ev_0002", 1, 1001, "cart", "s001", 12, "search", "mobile", "2024-01-15 08:13:10"),
    ("ev_0003", 2, 2001, "view", "s002", 120, "recommend", "pc", "2024-01-15 09:05:22"),
    ("ev_0004", 3, 3001, "view", "s003", 89, "search", "mobile", "2024-01-15 09:30:15"),
    ("ev_0005", 3, 3001, "wishlist", "s003", 5, "search", "mobile", "2024-01-15 09:31:00"),
    ("ev_0006", 4, 1002, "view", "s004", 200, "ad", "mobile", "2024-01-15 10:00:45"),
    ("ev_0007", 4, 1002, "purchase", "s004", 30, "ad", "mobile", "2024-01-15 10:04:00"),
    ("ev_0008", 5, 4001, "view", "s005", 340, "recommend", "pc", "2024-01-15 10:30:00"),
    ("ev_0009", 6, 5001, "view", "s006", 55, "search", "mobile", "2024-01-15 11:00:10"),
    ("ev_0010", 6, 5002, "view", "s006", 40, "search", "mobile", "2024-01-15 11:01:00"),
    ("ev_0011", 6, 5001, "cart", "s006", 8, "search", "mobile", "2024-01-15 11:01:50"),
    ("ev_0012", 7, 1003, "view", "s007", 180, "direct", "mobile", "2024-01-15 12:05:00"),
    ("ev_0013", 8, 2002, "view", "s008", 250, "recommend", "pc", "2024-01-15 13:20:00"),
    ("ev_0014", 9, 3002, "view", "s009", 95, "ad", "mobile", "2024-01-15 14:00:00"),
    ("ev_0015", 10, 4002, "view", "s010", 400, "recommend", "pc", "2024-01-15 15:30:00"),
    ("ev_0016", 1, 1001, "purchase", "s011", 20, "search", "mobile", "2024-01-16 08:30:00"),
    ("ev_0017", 2, 2001, "cart", "s012", 15, "recommend", "pc", "2024-01-16 09:10:00"),
    ("ev_0018", 3, 3001, "purchase", "s013", 25, "search", "mobile", "2024-01-16 09:45:00"),
    ("ev_0019", 4, 1005, "view", "s014", 130, "ad", "mobile", "2024-01-16 10:20:00"),
    ("ev_0020", 5, 4001, "cart", "s015", 10, "recommend", "pc", "2024-01-16 11:00:00"),
    ("ev_0021", 11, 1009, "view", "s016", 60, "search", "mobile", "2024-01-16 11:30:00"),
    ("ev_0022", 12, 2003, "view", "s017", 200, "direct", "pc", "2024-01-16 12:00:00"),
    ("ev_0023", 13, 5003, "view", "s018", 75, "search", "mobile", "2024-01-16 12:30:00"),
    ("ev_0024", 13, 5003, "purchase", "s018", 20, "search", "mobile", "2024-01-16 12:31:00"),
    ("ev_0025", 14, 3004, "view", "s019", 50, "recommend", "tablet", "2024-01-16 13:00:00"),
    ("ev_0026", 15, 1006, "view", "s020", 220, "ad", "pc", "2024-01-16 14:00:00"),
    ("ev_0027", 15, 1006, "cart", "s020", 12, "ad", "pc", "2024-01-16 14:04:00"),
    ("ev_0028", 16, 4003, "view", "s021", 300, "recommend", "mobile", "2024-01-16 15:00:00"),
    ("ev_0029", 17, 2004, "view", "s022", 180, "search", "pc", "2024-01-16 16:00:00"),
    ("ev_0030", 18, 5001, "purchase", "s023", 25, "ad", "mobile", "2024-01-16 17:00:00"),
    ("ev_0031", 1, 3001, "view", "s024", 100, "recommend", "mobile", "2024-01-17 08:00:00"),
    ("ev_0032", 2, 2001, "purchase", "s025", 40, "recommend", "pc", "2024-01-17 09:00:00"),
    ("ev_0033", 19, 1004, "view", "s026", 160, "search", "mobile", "2024-01-17 10:00:00"),
    ("ev_0034", 20, 4004, "view", "s027", 210, "direct", "pc", "2024-01-17 10:30:00"),
    ("ev_0035", 20, 4004, "cart", "s027", 8, "direct", "pc", "2024-01-17 10:32:00"),
    ("ev_0036", 21, 3005, "view", "s028", 280, "recommend", "pc", "2024-01-17 11:00:00"),
    ("ev_0037", 22, 5004, "view", "s029", 65, "search", "mobile", "2024-01-17 11:30:00"),
    ("ev_0038", 22, 5004, "purchase", "s029", 18, "search", "mobile", "2024-01-17 11:32:00"),
    ("ev_0039", 23, 1008, "view", "s030", 190, "ad", "mobile", "2024-01-17 12:00:00"),
    ("ev_0040", 24, 2005, "view", "s031", 240, "direct", "pc", "2024-01-17 13:00:00"),
    ("ev_0041", 25, 3006, "view", "s032", 70, "search", "mobile", "2024-01-17 14:00:00"),
    ("ev_0042", 26, 4005, "view", "s033", 330, "recommend", "pc", "2024-01-17 15:00:00"),
    ("ev_0043", 27, 1010, "view", "s034", 80, "ad", "mobile", "2024-01-17 16:00:00"),
    ("ev_0044", 28, 5005, "view", "s035", 90, "search", "mobile", "2024-01-17 16:30:00"),
    ("ev_0045", 29, 2006, "view", "s036", 200, "direct", "pc", "2024-01-17 17:00:00"),
    ("ev_0046", 1, 1001, "view", "s037", 30, "search", "mobile", "2024-02-01 09:00:00"),
    ("ev_0047", 5, 4001, "purchase", "s038", 35, "recommend", "pc", "2024-02-01 09:30:00"),
    ("ev_0048", 10, 4002, "purchase", "s039", 28, "recommend", "pc", "2024-02-01 10:00:00"),
    ("ev_0049", 15, 1006, "purchase", "s040", 22, "ad", "pc", "2024-02-01 10:30:00"),
    ("ev_0050", 30, 3007, "view", "s041", 120, "search", "mobile", "2024-02-01 11:00:00"),
    ("ev_0051", 30, 3007, "cart", "s041", 10, "search", "mobile", "2024-02-01 11:02:00"),
    ("ev_0052", 30, 3007, "purchase", "s041", 25, "search", "mobile", "2024-02-01 11:05:00"),
    ("ev_0053", 1, 2002, "view", "s042", 400, "recommend", "pc", "2024-03-01 10:00:00"),
    ("ev_0054", 1, 2002, "cart", "s042", 15, "recommend", "pc", "2024-03-01 10:07:00"),
    ("ev_0055", 2, 3001, "view", "s043", 90, "search", "mobile", "2024-03-01 11:00:00"),
    ("ev_0056", 3, 1002, "view", "s044", 250, "ad", "mobile", "2024-03-01 12:00:00"),
    ("ev_0057", 3, 1002, "purchase", "s044", 30, "ad", "mobile", "2024-03-01 12:05:00"),
    ("ev_0058", 7, 4006, "view", "s045", 600, "direct", "pc", "2024-03-01 13:00:00"),
    ("ev_0059", 8, 4007, "view", "s046", 500, "recommend", "pc", "2024-03-01 14:00:00"),
    ("ev_0060", 9, 5002, "purchase", "s047", 20, "search", "mobile", "2024-03-01 15:00:00"),
]

# The second edition of two tables differs in these names only.
SECOND_EDITION_PRODUCT_NAMES = {
    3001: "索尼 WH-1000XM5",
    4002: "追觅 X30 扫地机",
    4003: "石头 G20 扫地机",
    5002: "阿迪达斯 Ultra Boost",
}
SECOND_EDITION_CATEGORY_NAMES = {2: "笔记本"}

# Events of user_behavior that its second edition lacks; the others are numbered anew there, from ev_001.
SECOND_EDITION_LACKED_EVENTS = [
    "ev_0010", "ev_0014", "ev_0015", "ev_0028", "ev_0029", "ev_0030", "ev_0043", "ev_0044", "ev_0045",
]

# End of fixed values.


def _dated(rows: list[tuple]) -> list[tuple]:
    """Partitioned rows end in a time; the partition value is its date."""
    return [(*row, row[-1][:10]) for row in rows]


ROWS = {
    schemas.EMPLOYEES.name: EMPLOYEES,
    schemas.USER_PROFILES.name: USER_PROFILES,
    schemas.ORDERS.name: _dated(ORDERS),
    schemas.PRODUCTS.name: PRODUCTS,
    schemas.DIM_CATEGORY.name: DIM_CATEGORY,
    schemas.USER_BEHAVIOR.name: _dated(USER_BEHAVIOR),
}


def sample(spark: SparkSession, table: schemas.Table) -> DataFrame:
    return literal_rows(spark, ROWS[table.name], table.schema)


def load_sample_lake(spark: SparkSession, folder: str) -> None:
    """Create the databases and (re)load every table; running it again changes nothing."""
    for table in schemas.LAKE:
        database = table.name.split(".")[0]
        create_database(spark, database, DATABASE_COMMENTS.get(database), f"{folder}/{database}")
        rows = sample(spark, table)
        path = f"{folder}/{table.name.replace('.', '/')}"
        if table.external or not table.partition_by:
            replace_table(rows, table.name, path, table.fmt, table.partition_by)
        else:
            create_table(spark, table.name, table.schema, table.fmt, table.partition_by, compression="snappy")
            replace_partitions(rows, table.name)
