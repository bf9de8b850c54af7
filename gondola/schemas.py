"""Schemas of the landed inputs and of the tables that the operators keep."""

SOURCE = (
    "id string, label string, url string, city string, enabled boolean, scheduleMinutes int, maxSections int, maxPagesPerSection int, maxItemsPerPage int, workerCount int, "
    "productsWebhookUrl string, productsWebhookBatchSize int, adapterHint string, headless boolean, createdAt timestamp, updatedAt timestamp, lastRunAt timestamp, lastSuccessAt timestamp, latestJobId string, lastError string"
)
SOURCE_INPUT = "label string, url string, city string, adapterHint string, scheduleMinutes string, maxSections string, maxPagesPerSection string, maxItemsPerPage string, workerCount string, enabled string, headless string, productsWebhookUrl string, productsWebhookBatchSize string"
METRICS = "struct<totalSections:int,totalProducts:int,catalogDetected:boolean>"
OUTPUT = "struct<runDir:string,summaryPath:string,jsonPath:string,csvPath:string>"
JOB = f"id string, sourceId string, sourceLabel string, sourceUrl string, status string, reason string, startedAt timestamp, finishedAt timestamp, error struct<message:string>, adapterId string, output {OUTPUT}, metrics {METRICS}, logPath string"
BATCH_ITEM = f"struct<index:int,label:string,url:string,city:string,adapterHint:string,status:string,startedAt:timestamp,finishedAt:timestamp,jobId:string,metrics:{METRICS},error:string>"
BATCH = f"id string, label string, status string, reason string, startedAt timestamp, finishedAt timestamp, currentItemIndex int, currentJobId string, items array<{BATCH_ITEM}>, error string"
BATCH_INPUT = "label string, reason string, city string, adapterHint string, items array<struct<label:string,url:string,city:string,adapterHint:string>>, urls string, url string"
LOG = "at timestamp, level string, scope string, message string, context string"
PAGE = "page_id long, url string, html string"
CAPTURE = "url string, status int, content_type string, method string, post_data string, body string"
PRODUCT = (
    "id string, name string, price string, priceValue double, originalPrice string, originalPriceValue double, isPromotion boolean, promotionLabel string, badges array<string>, campaignLabel string, limitText string, "
    "isClubOffer boolean, isSiteExclusive boolean, discountPercent int, unit string, image string, link string, sectionId string, sectionLabel string, sectionUrl string, pageUrl string"
)
SHELF_PRODUCT = (
    "row_id string, product_id string, name string, price string, price_value double, original_price string, original_price_value double, discount_percent int, unit string, image_url string, product_url string, "
    "department_id string, department_label string, department_url string, page int, store_label string, effective_city string"
)
